import random

from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import shingle_dedup as sh


def brute_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_survivors(texts):
    """Least ids of the components of Jaccard >= 0.8."""
    sets = {i: brute_set(t) for i, t in enumerate(texts)}
    left, out = set(sets), set()
    while left:
        front = [min(left)]
        out.add(front[0])
        left -= set(front)
        while front:
            x = sets[front.pop()]
            near = {i for i in left if x == sets[i] or (x and sets[i] and 9 * len(x & sets[i]) >= 4 * (len(x) + len(sets[i])))}
            front += near
            left -= near
    return out


def corpus():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", " \t\n", "A b", "a  B", "one two three four five", "one two three four six"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(3, 400))]
        texts.append(" ".join(base))
        for k in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append("  ".join(copy))
    mark = [rng.choice(words) for _ in range(90)]  # large groups: similar ones, and ones just below
    texts += [" ".join([*mark, f"x{i}"]) for i in range(80)]
    texts += [" ".join([*mark[:40], *(f"y{i}_{j}" for j in range(30))]) for i in range(80)]
    texts += [" ".join([*mark[:30], f"z{i}", *mark[30:60]]) for i in range(60)]
    return texts


def test_stage_against_brute_force(spark, sf_dir):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in kept) == sorted(brute_survivors(texts))
    assert sh.keep_one(docs.limit(0)).count() == 0


def test_stage_on_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    want = {rows[i].doc_id for i in brute_survivors([r.text for r in rows])}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()} == want


def test_each_row_has_its_own_decision(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, b), (None, a), (None, "other"), (None, "other"), (3, a), (3, a)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in sh.keep_one(docs).collect()) == [(0, "other"), (1, a), (1, b)]


def test_large_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(sh, "SMALL", 2)
    monkeypatch.setattr(sh, "GIVEN", 0.2)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert sorted(r.doc_id for r in sh.keep_one(docs).collect()) == sorted(brute_survivors(texts))


def test_bitmaps_never_rule_out_too_much():
    rng = random.Random(3)
    for n, m in ((1, 1), (5, 70), (64, 65), (900, 1100), (3000, 200)):
        pool = [rng.getrandbits(64) for _ in range(n + m)]
        a = sh.np.unique(sh.np.array(pool[:n], sh.np.uint64))
        b = sh.np.unique(sh.np.array(pool[n // 2 : n // 2 + m], sh.np.uint64))
        apart = sh.bits_apart(sh.bitmap(a), sh.bitmap(b))
        assert sh.Bitmaps([sh.bitmap(a), sh.bitmap(b)]).apart(0, sh.np.arange(2)).tolist() == [0, apart]
        assert apart <= len(set(a.tolist()) ^ set(b.tolist())) and sh.bits_apart(sh.bitmap(a), sh.bitmap(a)) == 0


def test_fingerprints_link_first(spark, monkeypatch):
    """The generalised pigeonhole gives components by itself; the exact check undoes links of unlike texts."""
    rng = random.Random(11)
    texts = []
    for i in range(30):
        base = [f"v{i}_{rng.randrange(900)}" for _ in range(400)]
        texts += [" ".join(base), " ".join([*base, f"end{i}"]), " ".join([*base, "one", "more"])]
    texts += [f"short {i}" for i in range(40)]
    hashes = [sh.shingles(t.encode()) for t in texts]
    fps = [sh.fingerprint_of(h) for h in hashes]
    want, left = set(), set(range(len(texts)))
    while left:
        front = [min(left)]
        want.add(front[0])
        left -= set(front)
        while front:
            x = front.pop()
            near = {i for i in left if (fps[i] ^ fps[x]).bit_count() <= 4 and len(set(hashes[i]) & set(hashes[x])) * 9 >= 4 * (len(hashes[i]) + len(hashes[x]))}
            front += near
            left -= near
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(sh, "prefix", lambda hashes, common: hashes[:0])  # the exact way finds nothing
    kept = {r.doc_id for r in sh.keep_one(docs).collect()}
    assert kept == want and len(kept) < len(texts) - 40
    fp = spark.createDataFrame([(sh.node_of(h), f) for h, f in zip(hashes, fps, strict=True)], "node long, fp long").distinct()
    wide = {(r.a, r.b) for r in sh.linked(fp, 40).collect()}
    assert len(wide) >= len(texts) - 1  # at that radius also unlike texts are linked
    assert sh.possible(sh.linked(fp.limit(0)), fp.withColumn("place", F.col("fp")).withColumn("bits", F.lit(b""))).count() == 0
