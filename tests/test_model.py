"""The engine against a dictionary that does what PUT, DELETE and GET mean, over random traces; and hand-made cases."""

import hashlib
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tidelog.config import SHIPPED, EngineConfig
from tidelog.functions import entry, hashing
from tidelog.operators import catalog, compaction, fingerprint, merkle, numbering, point, policy, scan, sketch_values, sketches
from tidelog.operators.store import Store, TokenBucket
from tidelog.sources import wal
from tidelog.sources.views import runs_of
from tidelog.streaming import live

SCHEMA = "seq long, key string, value string, tombstone boolean, ts long"


def trace(n, seed, keys=30):
    rng, rows, ts = random.Random(seed), [], 1000
    for i in range(n):
        ts += rng.randint(0, 2)
        dead = rng.random() < 0.25
        rows.append((i, f"k{rng.randrange(keys):02d}", "" if dead else f"v{i}", dead, ts))
    return rows


def model(rows):
    store = {}
    for _, k, v, dead, _ in rows:
        if dead:
            store.pop(k, None)
        else:
            store[k] = v
    return store


@pytest.mark.parametrize("seed", [1, 2])
def test_store(spark, seed):
    rows = trace(300, seed)
    log = spark.createDataFrame(rows, SCHEMA)
    want = model(rows)
    assert {r.key: r.value for r in point.snapshot(log).collect()} == want
    runs = runs_of(log, 40)
    assert {r.key: r.value for r in scan.visible(runs).collect()} == want
    for after in (compaction.compact_full(runs, 7), compaction.size_tiered(runs)):
        moved = after.select(F.col("new_level").alias("level"), F.col("new_idx").alias("idx"), "key", "value", "tombstone", "ts")
        assert {r.key: r.value for r in scan.visible(moved).collect()} == want
    pages = [scan.range_scan(runs, "k00", "k99", i, 7).collect() for i in range(0, 7)]
    assert pages[0] == []
    flat = [r for p in pages for r in sorted(p, key=lambda r: r.pos)]
    assert [r.pos for r in flat] == list(range(1, len(want) + 1)) and {r.key for r in flat} == want.keys()
    assert [(r.idx, r.key) for r in flat] == sorted(((r.idx, r.key) for r in flat), key=lambda x: (-x[0], x[1]))
    for k in ("k03", "k07", "none"):
        assert [r.value for r in point.get(log, k).collect()] == ([want[k]] if k in want else [])
    late = point.put(point.delete(log, "k01", 9000), "k02", "late", 9001)
    now = {r.key: r.value for r in point.snapshot(late).collect()}
    assert "k01" not in now and now["k02"] == "late"
    with pytest.raises(ValueError):
        point.put(log, "SimHashX", "v", 1)
    seen, segment, want_cuts = set(), 0, []
    for _, k, *_ in rows:
        want_cuts.append(segment)
        seen.add(k)
        if len(seen) == 10:
            seen, segment = set(), segment + 1
    got = compaction.flush_exact(log, 10).orderBy("seq").collect()
    assert [r.segment for r in got] == want_cuts


def test_merge_ties(spark):
    rows = [(1, 1, "a", "old", False, 5, 0), (1, 2, "a", "new", False, 5, 1), (1, 1, "b", "x", True, 6, 2), (1, 2, "b", "y", False, 5, 3), (1, 1, "c", "z", False, 1, 4)]
    runs = spark.createDataFrame(rows, "level int, idx long, key string, value string, tombstone boolean, ts long, seq long")
    pick = lambda tie: {r.key: r.value for r in compaction.merge(runs, tie=tie).collect()}
    assert pick("newest") == {"a": "new", "b": "x", "c": "z"}
    assert pick("first") == {"a": "old", "b": "x", "c": "z"}


def test_entries(spark):
    df = spark.createDataFrame([("k", "välue", False, 1), ("", None, True, 2**40)], "key string, value string, tombstone boolean, ts long")
    back = df.select("*", entry.decode(entry.encode(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts"))).alias("e")).collect()
    for r in back:
        assert (r.e.key, r.e.value, r.e.tombstone, r.e.ts, r.e.intact) == (r.key, r.value or "", r.tombstone, r.ts, True)
    assert spark.range(1).select(F.crc32(F.lit("a"))).first()[0] == 3904355907
    assert spark.range(1).select(hashing.fnv1a32(F.lit("foobar"))).first()[0] == 3214735720
    assert spark.range(1).select(hashing.fnv1a32(F.lit(""))).first()[0] == 2166136261


def test_parameters():
    assert [sketches.bloom_params(n, p) for n, p in ((1000, 0.01), (100, 0.05), (40, 2.0), (20, 2.0))] == [(9586, 7), (624, 5), (58, 2), (29, 2)]
    assert [sketches.cms_params(e, d) for e, d in ((0.01, 0.01), (0.1, 0.1), (0.001, 0.01))] == [(272, 6), (28, 4), (2719, 6)]
    for bad in (lambda: sketches.bloom_params(10, 1), lambda: sketches.bloom_params(0, 0.1), lambda: sketches.cms_params(0, 0.1), lambda: sketches.hll_check(3)):
        with pytest.raises(ValueError):
            bad()
    assert SHIPPED.lsm_max_level == 7 and EngineConfig.of(lsm_max_level=2, wal_water_mark=10**6, compaction_type="x", skiplist_max_height=200) == EngineConfig.of(wal_water_mark=99_999, skiplist_max_height=99)
    with pytest.raises(ValueError):
        EngineConfig.of(unknown=1)


def test_sketches(spark):
    items = spark.createDataFrame([(f"i{i % 50}",) for i in range(1000)], "item string")
    others = spark.createDataFrame([(f"o{i}",) for i in range(500)], "item string")
    m, k = sketches.bloom_params(50, 0.01)
    bits = sketches.bloom_build(items, m, k, 7, "int")
    assert all(r.maybe for r in sketches.bloom_probe(items, bits, m, k, 7, "int").collect())
    assert sum(r.maybe for r in sketches.bloom_probe(others, bits, m, k, 7, "int").collect()) < 25
    m, k = sketches.cms_params(0.01, 0.01)
    est = {r.item: r.estimate for r in sketches.cms_estimate(items.union(others.limit(1)), sketches.cms_build(items, m, k, 7), m, k, 7).collect()}
    assert all(v >= 20 for i, v in est.items() if i[0] == "i")
    big = spark.range(20000).select(F.col("id").cast("string").alias("item"))
    got = sketches.hll_estimate(sketches.hll_registers(big, 12), 12).first().estimate
    assert abs(got / 20000 - 1) < 0.1
    none = sketches.hll_estimate(sketches.hll_registers(big.limit(0), 10), 10).collect()
    assert [r.estimate for r in none] == [0.0]


def test_fingerprints(spark):
    texts = spark.createDataFrame([(1, "hello!, world"), (2, "HELLO world,"), (3, "straße\nx  y")], "id long, text string")
    tokens = {(r.id, r.token): r.weight for r in fingerprint.tokens(texts).collect()}
    assert tokens == {(1, "HELLO"): 1, (1, "WORLD"): 1, (2, "HELLO"): 1, (2, "WORLD"): 1, (3, "STRAßE\nX"): 1, (3, ""): 1, (3, "Y"): 1}
    fp = {r.id: r.fingerprint for r in fingerprint.fingerprints(texts).collect()}
    assert fp[1] == fp[2] != fp[3] and all(len(x) == 256 for x in fp.values())


def test_merkle(spark):
    leaves = spark.createDataFrame([(0, 0, "a"), (1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "b"), (2, 2, "c")], "tree long, pos long, data string")
    compat = {r.tree: r.root for r in merkle.roots_compat(leaves).collect()}
    assert compat == {0: "0" * 40, 1: "da23614e02469a0d7c7bd1bdab5c9c474b1904dc", 2: merkle.EMPTY}
    assert len({r.root for r in merkle.roots(leaves, 3).collect()}) == 3
    many = spark.range(600).select(F.lit(0).alias("tree"), F.col("id").alias("pos"), F.col("id").cast("string").alias("data"))
    row = [hashlib.sha1(str(i).encode()).digest() for i in range(600)]
    while len(row) > 1:
        row = [hashlib.sha1(row[i] + (row[i + 1] if i + 1 < len(row) else hashlib.sha1().digest())).digest() for i in range(0, len(row), 2)]
    assert [r.root for r in merkle.roots(many, 3).collect()] == [row[0].hex()]


def test_policies(spark):
    rng = random.Random(3)
    rows = [(i, f"k{rng.choice([rng.randrange(4), rng.randrange(30)])}") for i in range(600)]
    cache, hits = OrderedDict(), []
    for _, k in rows:
        hits.append(k in cache)
        cache[k] = None
        cache.move_to_end(k)
        if len(cache) > 5:
            cache.popitem(last=False)
    for chunk, fan in ((50, 1000), (20, 3), (100_000, 1000)):
        got = policy.lru_hits(spark.createDataFrame(rows, "seq long, key string"), 5, chunk, fan).orderBy("seq").collect()
        assert [r.hit for r in got] == hits
    at = [0, 0, 0, 10_000, 50_000, 150_000, 1_000_000]
    calls = spark.createDataFrame([(7, a, i) for i, a in enumerate(at)], "principal long, at long, id long")
    got = {r.id: r.admitted for r in policy.token_bucket(calls, 2, 10).collect()}
    assert [got[i] for i in range(7)] == [True, True, False, False, False, True, True]


def test_numbering_and_wal(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"))
    got = numbering.numbered(rows, ["x"]).collect()
    assert sorted((r.x, r.pos) for r in got) == [(i, i + 1) for i in range(5000)]
    log = spark.createDataFrame(trace(100, 5), SCHEMA)
    path = str(tmp_path / "wal")
    wal.write_batches(log, path, 30)
    assert sorted(map(tuple, spark.read.parquet(path).select(*log.columns).collect())) == sorted(map(tuple, log.collect()))
    assert wal.newest_segment(log, 30).count() == 10 and {r.segment for r in wal.retained(log, 30, 2).collect()} == {0, 1}
    assert wal.newest_segment(log.limit(0), 30).count() == 0


def test_catalog(spark):
    log = spark.createDataFrame([(0, "SimHashA", "1", False, 1), (1, "SimHashA", "2", False, 2), (2, "BloomFilterB", "x", False, 1), (3, "BloomFilterB", "", True, 2), (4, "plain", "v", False, 1)], SCHEMA)
    assert sorted(map(tuple, catalog.entries(log).collect())) == [("SimHash", "A", "2", 2), ("value", "plain", "v", 1)]


def test_streams(spark, tmp_path):
    rows = trace(120, 9)
    source = str(tmp_path / "in")
    for i in range(0, 120, 40):
        spark.createDataFrame(rows[i : i + 40], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = live.keep_snapshot(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert {r.key: r.value for r in live.read_snapshot(spark, str(tmp_path / "out"), 2).collect()} == model(rows)
    calls = spark.createDataFrame([(p, i * 30_000, i) for i in range(40) for p in (1, 2)], "principal long, at long, id long")
    calls.coalesce(1).write.parquet(str(tmp_path / "calls"))
    live_calls = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls"))
    q = live.admit(live_calls, 3, 10).writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, policy.token_bucket(calls, 3, 10).collect()))
    assert sorted(map(tuple, spark.table("admitted").collect())) == want


def compacted(store, max_level, multiplier=None, size=None):
    """store: {level: [run, ...]}, a run {key: (ts, value, tombstone)}; lower levels and later runs are newer."""

    def merged(runs):
        out = {}
        for run in runs:  # from old to new
            for k, v in run.items():
                if k not in out or v[0] >= out[k][0]:
                    out[k] = v
        return out

    store = {lv: list(store.get(lv, [])) for lv in range(1, max_level + 1)}
    for lv in range(1, max_level):
        own, above = store[lv], store[lv + 1]
        if multiplier is None:
            if len(own) >= 2:
                store[lv + 1] = above + [merged(own[i : i + 2]) for i in range(0, len(own) - 1, 2)]
                store[lv] = own[len(own) // 2 * 2 :]
            continue
        take = len(own) - (0 if lv == 1 else multiplier ** (lv - 1))
        if take > 0:
            low, high = min(min(r) for r in own[:take]), max(max(r) for r in own[:take])
            hit = [r for r in above if not (max(r) < low or min(r) > high)]
            rows = sorted(merged(hit + own[:take]).items())
            new = [dict(rows[i : i + size]) for i in range(0, len(rows), size)]
            store[lv + 1] = sorted([r for r in above if r not in hit] + new, key=min)
            store[lv] = own[take:]
    return store


def as_store(rows, level="level", idx="idx"):
    out = {}
    for r in rows:
        out.setdefault(r[level], {}).setdefault(r[idx], {})[r["key"]] = (r["ts"], r["value"], r["tombstone"])
    return {lv: [runs[i] for i in range(1, len(runs) + 1)] for lv, runs in out.items()}


@pytest.mark.parametrize("leveled", [False, True])
def test_stores_of_several_levels(spark, leveled):
    """Two compactions with new runs between them, against lists and dictionaries."""
    rows = trace(260, 4, keys=60)
    runs = runs_of(spark.createDataFrame(rows, SCHEMA), 20).drop("seq")
    columns = ["level", "idx", "key", "value", "tombstone", "ts"]
    first, later = runs.filter("idx <= 7").select(*columns), runs.filter("idx > 7").withColumn("idx", F.col("idx") - 7).select(*columns)
    want = as_store(first.collect())
    for new in (None, later):
        if new is not None:
            old = as_store(new.collect())
            want = {**want, 1: want.get(1, []) + old[1]}
            kept = len(want[1]) - len(old[1])
            first = now.union(new.withColumn("idx", F.col("idx") + kept))  # noqa: F821
        if leveled:
            now, want = compaction.compact_leveled(first, 4, 2, 5), compacted(want, 4, 2, 5)
        else:
            moved = compaction.compact_full(first, 4)
            now = moved.select(F.col("new_level").alias("level"), F.col("new_idx").alias("idx"), "key", "value", "tombstone", "ts")
            want = compacted(want, 4)
        now = numbering.checkpointed(now)
        assert as_store(now.collect()) == {lv: r for lv, r in want.items() if r}
    policy_ = "leveled" if leveled else "size_tiered"
    live_ = {r.key: r.value for r in point.find(now, policy_).filter("not tombstone").collect()}
    assert live_ == model(rows)


def test_get_asks_memtable_cache_and_runs_in_order(spark):
    runs = spark.createDataFrame([(1, 1, "a", "old", False, 1), (1, 2, "a", "run", False, 2), (1, 2, "b", "b", False, 2), (1, 1, "c", "c", False, 1), (1, 2, "c", "", True, 9)], "level int, idx long, key string, value string, tombstone boolean, ts long")
    now = [0.0]
    store = Store(spark.createDataFrame([], SCHEMA), runs, TokenBucket(100, 1, lambda: now[0]), 2)
    assert store.get("a") == (True, ("run", 2)) and store.get("c") == (False, None) and store.get("none") == (False, None)
    store.runs = runs.filter("key <> 'a'")
    assert store.get("a") == (True, ("run", 2))  # from the cache
    assert store.put("a", "mem", 3) and store.get("a") == (True, ("mem", 3))
    assert store.delete("a", 4) and "a" not in store.cache and store.get("a") == (False, None)
    with pytest.raises(ValueError):
        store.put("SimHashX", "v", 5)
    store.gate = TokenBucket(1, 2, lambda: now[0])
    assert store.put("x", "1", 6) and not store.put("x", "2", 7) and not store.delete("x", 8) and store.get("x") == (False, None)
    now[0] = 0.6
    assert store.get("x") == (True, ("1", 6))


def test_sketch_values(spark):
    log = spark.createDataFrame([], SCHEMA)
    print_ = fingerprint.fingerprints(spark.createDataFrame([(1, "some text")], "id long, text string")).select("fingerprint")
    log = sketch_values.put(log, "SimHash", "S", sketch_values.simhash_value(print_), 1)
    assert sketch_values.get(log, "SimHash", "S").first().fingerprint == print_.first().fingerprint
    none = spark.createDataFrame([], "item string")
    log = sketch_values.put(log, "BloomFilter", "E", sketch_values.bloom_value(sketches.bloom_build(none, 10, 2, 0), 10, 2, 0), 2)
    probes = spark.createDataFrame([("x",), ("y",)], "item string")
    assert [r.maybe for r in sketch_values.bloom_asks(log, "E", probes).collect()] == [False, False]
    assert sketch_values.bloom_asks(log, "nobody", probes) is None and sketch_values.hll_asks(log, "H") is None
    gone = point.delete(log, "BloomFilterE", 3)
    assert sketch_values.bloom_asks(gone, "E", probes) is None
    with pytest.raises(ValueError):
        sketch_values.put(log, "Other", "x", sketch_values.simhash_value(print_), 1)


def test_config_file(tmp_path):
    path = tmp_path / "settings.yml"
    path.write_text('memtable_size: 40\nmemtable_structure: "skiplist"  # comment\ntoken_cap: many\nlsm_max_level: 7\nother: 1\ntoken_rate:\nbloom_falsepositive_rate: 0.5\n\n')
    assert EngineConfig.load(str(path)) == EngineConfig.of(memtable_size=40, memtable_structure="skiplist", lsm_max_level=7, bloom_falsepositive_rate=0.5)


def rows_of(spark, df, node):
    """How many rows the plan's nodes of that name made, at most by one of them, when df was collected; and what was collected."""
    got = df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    run = store.executionsList().last().executionId()
    values, nodes, found = store.executionMetrics(run), store.planGraph(run).allNodes(), []
    for i in range(nodes.size()):
        if nodes.apply(i).name() == node:
            metrics = nodes.apply(i).metrics()
            for m in (metrics.apply(k) for k in range(metrics.size())):
                if m.name() in ("number of output rows", "shuffle records written") and values.contains(m.accumulatorId()):
                    found.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return max(found), got


def test_runs_that_span_everything_are_not_met_once_a_range(spark):
    """Each pair of runs is looked at where the later one begins, and not in each range that both span."""
    rows = [(1, i, k) for i in range(400) for k in (f"a{(i * 7) % 400:04d}", f"z{(i * 11) % 400:04d}")]
    rows += [(1, 400, "a0000"), (1, 401, "zz"), (1, 402, "zz"), (1, 403, None)]
    made, got = rows_of(spark, scan.overlaps(spark.createDataFrame(rows, "level int, idx long, key string")), "Generate")
    ends = {}
    for _, i, k in rows:
        if k is not None:
            ends.setdefault(i, []).append(k)
    want = [(i, j) for i in ends for j in ends if i < j and not (max(ends[i]) < min(ends[j]) or min(ends[i]) > max(ends[j]))]
    assert sorted(map(tuple, got)) == sorted(want)
    assert made <= 16 * 403


def test_near_pairs_are_not_shuffled(spark, monkeypatch):
    """What is dealt out grows with the fingerprints, not with their pairs; and no pair is lost or given twice over several blocks."""
    rng = random.Random(5)
    prints = set()
    for _ in range(3):
        base = [rng.choice("01") for _ in range(256)]
        for _ in range(150):
            x = list(base)
            for i in rng.sample(range(256), rng.randint(0, 8)):
                x[i] = "10"[int(x[i])]
            prints.add("".join(x))
    prints = sorted(prints | {"0" * 256, "1" * 256, "1" + "0" * 255, "0" * 32 + "1" * 12 + "0" * 212, "0" * 32 + "1" * 13 + "0" * 211})
    apart = lambda x, y: sum(p != q for p, q in zip(x, y, strict=True))
    want = sorted((x, y, d) for i, x in enumerate(prints) for y in prints[i + 1 :] if (d := apart(x, y)) <= 12)
    df = spark.createDataFrame([(x,) for x in prints + prints], "fingerprint string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large tables
    try:
        dealt, got = rows_of(spark, fingerprint.near_pairs(df, 12), "Exchange")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, got)) == want and len(want) > 10_000
    assert dealt <= 4 * len(prints)
    monkeypatch.setattr(fingerprint, "BLOCK", 100)
    assert sorted(map(tuple, fingerprint.near_pairs(df, 12).collect())) == want


def test_near_pairs_on_disk_grow_with_the_fingerprints_over_many_blocks(spark, monkeypatch):
    """Each fingerprint is dealt out a fixed number of times, however many blocks there are; also with several blocks in a partition and many rows out of one block."""
    rng = random.Random(6)
    prints = set()
    for _ in range(3):
        base = [rng.choice("01") for _ in range(256)]
        for _ in range(130):
            x = list(base)
            for i in rng.sample(range(256), rng.randint(0, 9)):
                x[i] = "10"[int(x[i])]
            prints.add("".join(x))
    prints = sorted(prints | {"0" * 256, "1" * 256, "01" * 128, "10" * 128, "0" * 255 + "1", "1" * 64 + "0" * 192, "1" * 63 + "0" * 193})
    apart = lambda x, y: sum(p != q for p, q in zip(x, y, strict=True))
    want = sorted((x, y, d) for i, x in enumerate(prints) for y in prints[i + 1 :] if (d := apart(x, y)) <= 12)
    df = spark.createDataFrame([(x,) for x in [*prints, *prints, None]], "fingerprint string")
    monkeypatch.setattr(fingerprint, "BLOCK", 20)
    dealt, got = rows_of(spark, fingerprint.near_pairs(df, 12), "Exchange")
    assert sorted(map(tuple, got)) == want and len(want) > 5_000
    assert dealt <= 4 * len(prints)
    monkeypatch.setattr(fingerprint, "PARTITIONS", 3)
    assert sorted(map(tuple, fingerprint.near_pairs(df, 12).collect())) == want
    packed = [int(x, 2).to_bytes(32, "big") for x in prints]
    for tile, rows in ((512, 1 << 14), (64, 40)):
        monkeypatch.setattr(fingerprint, "TILE", tile)
        monkeypatch.setattr(fingerprint, "PAIRS", rows)
        found = [r for b in fingerprint.met(packed, packed[::-1], 12) for r in b.to_pylist()]
        assert max(len(r["pairs"]) for r in found) <= rows
        assert sorted((r["texts_a"][p >> 40], r["texts_b"][p >> 9 & (1 << 31) - 1], p & 511) for r in found for p in r["pairs"]) == want
    assert fingerprint.near_pairs(df.limit(0), 12).count() == 0
