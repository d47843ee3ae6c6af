"""Registered queries over the sample tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SHIPPED
from ..functions import entry, hashing
from ..operators import catalog, compaction, fingerprint, inspect, merkle, point, policy, scan, sketch_values, sketches, store
from ..operators.numbering import checkpointed
from ..sources import generate, wal
from ..sources.views import CHUNK, KV, KV_COARSE, WIDE, kv_log, kv_log_coarse, kv_log_wide, kv_runs, newest, runs_of, runs_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RUNS = f"{KV}, {runs_sql()}"
LIVE = "ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM kv), live AS (SELECT key, value, ts FROM ranked WHERE rn = 1 AND NOT tombstone)"
VISIBLE = "vis AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS vn FROM runs) WHERE vn = 1 AND NOT tombstone)"
CAP, KEEP = 400, 3
HOT_KEY = "u000007"


# Sources and encodings


def _scratch(df: DataFrame) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    sc = df.sparkSession.sparkContext
    checkpointed(df.limit(0))  # sets a folder where the session has none
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


@query(f"WITH {KV} SELECT * FROM kv")
def wal_append_readback(spark, sf_dir):
    log = kv_log(spark, sf_dir)
    path = _scratch(log)
    wal.append(log.filter("seq % 2 = 0"), path)
    wal.append(log.filter("seq % 2 = 1"), path)
    return wal.read(spark, path)


@query(f"WITH {KV} SELECT *, seq // {CAP} AS segment FROM kv")
def wal_batches(spark, sf_dir):
    return wal.batches(kv_log(spark, sf_dir), CAP)


@query(f"WITH {KV} SELECT key, value, tombstone, ts, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM kv WHERE seq // {CAP} = (SELECT max(seq) // {CAP} FROM kv)) WHERE rn = 1")
def wal_recover(spark, sf_dir):
    """The memtable after a restart: the newest segment, replayed."""
    return newest(wal.newest_segment(kv_log(spark, sf_dir), CAP), ["key"], ["seq"]).select("key", "value", "tombstone", "ts", "seq")


@query(f"WITH {KV} SELECT row_number() OVER (ORDER BY seq) AS pos, seq // {CAP} AS segment, key, tombstone, ts FROM kv")
def wal_dump(spark, sf_dir):
    from ..operators.numbering import numbered

    return numbered(wal.batches(kv_log(spark, sf_dir), CAP).select("segment", "seq", "key", "tombstone", "ts"), ["segment", "seq"]).drop("seq")


@query(f"WITH {KV} SELECT *, seq // {CAP} - (SELECT greatest(0, max(seq) // {CAP} - {KEEP - 1}) FROM kv) AS segment FROM kv WHERE seq // {CAP} >= (SELECT max(seq) // {CAP} - {KEEP - 1} FROM kv)")
def wal_retention(spark, sf_dir):
    return wal.retained(kv_log(spark, sf_dir), CAP, KEEP)


_BODY = """lower(printf('%016x', ts) || CASE WHEN tombstone THEN '01' ELSE '00' END || printf('%016x', strlen(key)) || printf('%016x', strlen(coalesce(value, ''))) || hex(encode(key)) || hex(encode(coalesce(value, ''))))"""


@query(f"WITH {KV} SELECT seq, {_BODY} AS body FROM kv")
def entry_encode(spark, sf_dir):
    """Everything behind the checksum, in hex."""
    return kv_log(spark, sf_dir).select("seq", F.lower(F.hex(entry.body(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts")))).alias("body"))


@query(f"WITH {KV} SELECT seq, key, coalesce(value, '') AS value, tombstone, ts, true AS intact FROM kv")
def entry_roundtrip(spark, sf_dir):
    data = kv_log(spark, sf_dir).select("seq", entry.encode(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts")).alias("data"))
    return data.select("seq", entry.decode(F.col("data")).alias("e")).select("seq", "e.key", "e.value", "e.tombstone", "e.ts", "e.intact")


_BYTES = f"list_transform(range(0, strlen(body) // 2), lambda i: ('0x' || substr(body, 2 * i + 1, 2))::BIGINT)"
_EIGHT = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"


@query(f"WITH {KV}, e AS (SELECT seq, {_BODY} AS body FROM kv) SELECT seq, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, b: {_EIGHT}), 4294967295)::BIGINT AS crc FROM e")
def entry_crc(spark, sf_dir):
    return kv_log(spark, sf_dir).select("seq", F.crc32(entry.body(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts"))).alias("crc"))


@query(f"WITH {KV} SELECT seq % 5 = 0 AS damaged, seq % 5 <> 0 AS intact, count(*) AS n FROM kv GROUP BY 1, 2")
def crc_audit(spark, sf_dir):
    """Every fifth entry gets one wrong byte; the audit must find those and no others."""
    data = kv_log(spark, sf_dir).select("seq", entry.encode(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts")).alias("data"))
    flipped = F.concat(F.substring("data", 1, 12), F.when(F.hex(F.substring("data", 13, 1)) == "00", F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), F.expr("substring(data, 14)"))
    data = data.withColumn("damaged", F.col("seq") % 5 == 0).withColumn("data", F.when(F.col("seq") % 5 == 0, flipped).otherwise(F.col("data")))
    return data.groupBy("damaged", entry.decode(F.col("data"))["intact"].alias("intact")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RUNS} SELECT level, idx, key, value, tombstone, ts FROM runs")
def sstable_flush(spark, sf_dir):
    """Runs written as sorted Parquet by level and idx, with a Bloom filter on key, and read back."""
    runs = kv_runs(spark, sf_dir).drop("seq")
    path = _scratch(runs)
    runs.repartition("level", "idx").sortWithinPartitions("level", "idx", "key").write.partitionBy("level", "idx").option("parquet.bloom.filter.enabled#key", "true").parquet(path)
    return spark.read.schema(runs.schema).parquet(path)


@query(f"WITH {RUNS} SELECT level, idx, row_number() OVER (PARTITION BY level, idx ORDER BY key) AS pos, key, value, tombstone, ts FROM runs")
def sstable_dump(spark, sf_dir):
    from pyspark.sql import Window

    return kv_runs(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("level", "idx").orderBy("key"))).drop("seq")


_SIZE = "(strlen(key) + strlen(coalesce(value, '')) + 29)"


@query(f"WITH {RUNS} SELECT level, idx, key, (sum({_SIZE}) OVER (PARTITION BY level, idx ORDER BY key) - {_SIZE})::BIGINT AS \"offset\" FROM runs")
def sstable_index(spark, sf_dir):
    return inspect.index(kv_runs(spark, sf_dir))


@query(
    f"WITH {RUNS}, r AS (SELECT level, idx, key, row_number() OVER (PARTITION BY level, idx ORDER BY key) AS rn, min(key) OVER (PARTITION BY level, idx) AS first_key, max(key) OVER (PARTITION BY level, idx) AS last_key FROM runs) "
    f"SELECT level, idx, key, first_key, last_key, (rn - 1) // {SHIPPED.sstable_interval} AS slot FROM r WHERE (rn - 1) % {SHIPPED.sstable_interval} = 0"
)
def sstable_summary(spark, sf_dir):
    return inspect.summary(kv_runs(spark, sf_dir), SHIPPED.sstable_interval)


@query(f"WITH {RUNS} SELECT l.level, coalesce(n, 0) AS n_runs FROM (SELECT unnest(range(1, {SHIPPED.lsm_max_level + 1}))::INT AS level) l LEFT JOIN (SELECT level, count(DISTINCT idx) AS n FROM runs GROUP BY 1) USING (level)")
def lsm_level_sizes(spark, sf_dir):
    return inspect.level_sizes(kv_runs(spark, sf_dir), SHIPPED.lsm_max_level)


# Point operations


@query(f"WITH {KV} SELECT seq, key, value, tombstone, ts FROM kv UNION ALL SELECT (SELECT max(seq) + 1 FROM kv), 'new-key', 'new-value', false, 1900000000")
def kv_put(spark, sf_dir):
    return point.put(kv_log(spark, sf_dir), "new-key", "new-value", 1_900_000_000)


@query(f"WITH k0 AS (SELECT * FROM events), {KV}, all_ AS (SELECT * FROM kv UNION ALL SELECT (SELECT max(seq) + 1 FROM kv), '{HOT_KEY}', '', true, 1900000000), ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM all_) SELECT key, value, ts FROM ranked WHERE rn = 1 AND NOT tombstone")
def kv_delete(spark, sf_dir):
    """The snapshot after a DELETE."""
    return point.snapshot(point.delete(kv_log(spark, sf_dir), HOT_KEY, 1_900_000_000))


@query(f"WITH {KV}, {LIVE} SELECT * FROM live WHERE key = '{HOT_KEY}'")
def kv_get(spark, sf_dir):
    return point.get(kv_log(spark, sf_dir), HOT_KEY)


@query(f"WITH {KV}, {LIVE} SELECT * FROM live WHERE key IN (SELECT 'u' || lpad(c_custkey::VARCHAR, 6, '0') FROM customer WHERE c_nationkey < 5)")
def kv_multi_get(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").filter("c_nationkey < 5").select(F.concat(F.lit("u"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key"))
    return point.multi_get(kv_log(spark, sf_dir), keys)


@query(f"WITH {RUNS} SELECT key, level, idx, value, tombstone, ts FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level, idx DESC) AS vn FROM runs) WHERE vn = 1")
def lsm_find(spark, sf_dir):
    return point.find(kv_runs(spark, sf_dir))


def _trace_sql(key: str, p: float, n: int, seed0: int) -> str:
    m, k = sketches.bloom_params(n, p)
    bits = lambda item: "[" + ", ".join(hashing.bucket_sql(item, seed0 + i, m) for i in range(k)) + "]"
    return f"""WITH {RUNS}, b AS (SELECT level, idx, key, unnest({bits("key")}) AS bit FROM runs), want AS (SELECT DISTINCT unnest({bits(f"'{key}'")}) AS bit),
    hit AS (SELECT level, idx, count(DISTINCT bit) AS n FROM b WHERE bit IN (SELECT bit FROM want) GROUP BY 1, 2),
    ends AS (SELECT level, idx, min(key) AS f, max(key) AS l, max(CASE WHEN key = '{key}' THEN 1 ELSE 0 END) AS has FROM runs GROUP BY 1, 2)
    SELECT level, idx, CASE WHEN coalesce(n, 0) < (SELECT count(*) FROM want) THEN 'bloom' WHEN f > '{key}' OR l < '{key}' THEN 'range' WHEN has = 0 THEN 'index' ELSE 'hit' END AS gate FROM ends LEFT JOIN hit USING (level, idx)"""


@query(_trace_sql(HOT_KEY, 0.01, CHUNK, 1000))
def sstable_find_trace(spark, sf_dir):
    return inspect.find_trace(kv_runs(spark, sf_dir), HOT_KEY, 0.01, 1000, CHUNK)


@query(f"WITH {RUNS}, last AS (SELECT max(idx) AS n FROM runs), src AS (SELECT CASE WHEN idx = n THEN 0 ELSE 1 END AS s, runs.* FROM runs, last), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s, idx DESC) AS vn FROM src) SELECT key, s = 0 AS in_memory, value, ts FROM f WHERE vn = 1 AND NOT tombstone")
def kv_get_by_source(spark, sf_dir):
    """Every key as GET finds it: the newest chunk is the memtable, then runs from new to old; the first that has the key decides."""
    runs = kv_runs(spark, sf_dir)
    last = runs.agg(F.max("idx").alias("n")).first()["n"]
    sources = store.sources_of(runs.filter(F.col("idx") == F.lit(last)), runs.filter(F.col("idx") < F.lit(last)))
    found = store.lookup(sources, runs.select("key")).filter(~F.col("tombstone"))
    return found.select("key", (F.col("source.a") == 0).alias("in_memory"), "value", "ts")


@query(f"WITH {KV}, {LIVE} SELECT * FROM live")
def kv_snapshot(spark, sf_dir):
    return point.snapshot(kv_log(spark, sf_dir))


@query(f"WITH all_ AS (SELECT * FROM events), {KV}, cut AS (SELECT * FROM kv WHERE ts <= 1709251200), ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM cut) SELECT key, value, ts FROM ranked WHERE rn = 1 AND NOT tombstone")
def kv_as_of(spark, sf_dir):
    return point.as_of(kv_log(spark, sf_dir), 1_709_251_200)


# Scans

PAGE, SIZE = 2, 5
_PAGED = "SELECT key, level, idx, value, ts, pos FROM (SELECT *, row_number() OVER (ORDER BY level, idx DESC, key) AS pos FROM vis {where}) WHERE pos > {a} AND pos <= {b}"


@query(f"WITH {RUNS}, {VISIBLE} " + _PAGED.format(where="WHERE key BETWEEN 'u000002' AND 'u000090'", a=(PAGE - 1) * SIZE, b=PAGE * SIZE))
def range_scan_page(spark, sf_dir):
    return scan.range_scan(kv_runs(spark, sf_dir), "u000002", "u000090", PAGE, SIZE)


WIDE_CHUNK = 40
WIDE_RUNS = f"{WIDE}, {runs_sql(WIDE_CHUNK)}"


def _wide_runs(spark, sf_dir):
    return runs_of(kv_log_wide(spark, sf_dir), WIDE_CHUNK)


@query(f"WITH {WIDE_RUNS}, {VISIBLE} " + _PAGED.format(where="WHERE starts_with(key, 'small')", a=(PAGE - 1) * SIZE, b=PAGE * SIZE))
def prefix_scan_page(spark, sf_dir):
    return scan.prefix_scan(_wide_runs(spark, sf_dir), "small", PAGE, SIZE)


@query(f"WITH {RUNS}, {VISIBLE} SELECT key, level, idx, value, ts FROM vis")
def scan_visible_keys(spark, sf_dir):
    return scan.visible(kv_runs(spark, sf_dir))


@query("SELECT n AS number, s AS size, CASE WHEN n < 1 THEN 1 ELSE (n - 1) * s + 1 END AS first_row, greatest(0, n * s) AS last_row FROM (SELECT unnest(range(0, 6)) AS n), (SELECT unnest([5::BIGINT, 10::BIGINT]) AS s)")
def scan_page_bounds(spark, sf_dir):
    pages = spark.range(0, 6).select(F.col("id").alias("number"), F.explode(F.array(F.lit(5).cast("long"), F.lit(10).cast("long"))).alias("size"))
    return scan.bounds(pages)


_LAST = "(SELECT max(idx) FROM runs)"


@query(f"WITH {RUNS} SELECT CASE WHEN idx = {_LAST} THEN 0 ELSE 1 END AS source, CASE WHEN idx = {_LAST} THEN 0 ELSE idx END AS idx, key, value, tombstone, ts FROM runs")
def lsm_dump(spark, sf_dir):
    """The newest chunk stands for the memtable, source 0."""
    runs = kv_runs(spark, sf_dir)
    last = runs.agg(F.max("idx").alias("n")).first()["n"]
    memory = F.col("idx") == F.lit(last)
    return runs.select(F.when(memory, 0).otherwise(1).alias("source"), F.when(memory, 0).otherwise(F.col("idx")).alias("idx"), "key", "value", "tombstone", "ts")


@query(f"WITH {RUNS} SELECT row_number() OVER (ORDER BY key) AS pos, key, value, tombstone, ts FROM runs WHERE idx = {_LAST}")
def memtable_sorted(spark, sf_dir):
    from ..operators.numbering import numbered

    runs = kv_runs(spark, sf_dir)
    last = runs.agg(F.max("idx").alias("n")).first()["n"]
    return numbered(runs.filter(F.col("idx") == F.lit(last)).select("key", "value", "tombstone", "ts"), ["key"])


@query(f"WITH {WIDE_RUNS}, e AS (SELECT idx, min(key) AS f, max(key) AS l FROM runs GROUP BY 1) SELECT a.idx AS idx_a, b.idx AS idx_b FROM e a JOIN e b ON a.idx < b.idx AND NOT (a.l < b.f OR a.f > b.l)")
def run_overlaps(spark, sf_dir):
    return scan.overlaps(_wide_runs(spark, sf_dir))


# Flush and compaction


@query(
    f"""WITH RECURSIVE {KV}, n AS (SELECT seq, key, row_number() OVER (ORDER BY seq) AS i FROM kv),
    f AS (SELECT i, seq, key, 0::BIGINT AS segment, CASE WHEN {SHIPPED.memtable_size} = 1 THEN []::VARCHAR[] ELSE [key] END AS seen, CASE WHEN {SHIPPED.memtable_size} = 1 THEN 1::BIGINT ELSE 0::BIGINT END AS next FROM n WHERE i = 1
          UNION ALL SELECT n.i, n.seq, n.key, f.next, CASE WHEN list_contains(f.seen, n.key) THEN f.seen WHEN len(f.seen) + 1 = {SHIPPED.memtable_size} THEN [] ELSE list_append(f.seen, n.key) END,
                 CASE WHEN NOT list_contains(f.seen, n.key) AND len(f.seen) + 1 = {SHIPPED.memtable_size} THEN f.next + 1 ELSE f.next END FROM f JOIN n ON n.i = f.i + 1)
    SELECT 0 AS shard, seq, key, segment FROM f"""
)
def flush_segments_exact(spark, sf_dir):
    return compaction.flush_exact(kv_log(spark, sf_dir), SHIPPED.memtable_size)


@query(f"WITH {KV} SELECT seq, key, value, tombstone, ts, seq // {SHIPPED.memtable_size} AS segment FROM kv")
def flush_segments_chunked(spark, sf_dir):
    return compaction.flush_chunked(kv_log(spark, sf_dir), SHIPPED.memtable_size)


def _cascade_sql(max_level: int, runs: str = "runs") -> str:
    """Levels and numbers after the cascade, one step for each level; a level's runs come before those that move up to it."""
    there = lambda lv: f"(SELECT coalesce(max(idx), 0) FROM {runs} WHERE level = {lv})"
    out = f"m1 AS (SELECT {there(1)} AS m), c1 AS (SELECT *, level AS new_level, idx AS new_idx FROM {runs})"
    for lv in range(1, max_level):
        up = f"new_level = {lv} AND new_idx <= (SELECT m // 2 * 2 FROM m{lv})"
        out += f", m{lv + 1} AS (SELECT {there(lv + 1)} + m // 2 AS m FROM m{lv})"
        out += f", c{lv + 1} AS (SELECT * REPLACE (CASE WHEN {up} THEN {lv + 1} ELSE new_level END AS new_level, CASE WHEN {up} THEN {there(lv + 1)} + (new_idx + 1) // 2 WHEN new_level = {lv} THEN 1 ELSE new_idx END AS new_idx) FROM c{lv})"
    return out


_KEPT = "SELECT new_level, new_idx, key, value, tombstone, ts FROM (SELECT *, row_number() OVER (PARTITION BY new_level, new_idx, key ORDER BY ts DESC, level, idx DESC) AS kn FROM {t}) WHERE kn = 1"
_KEPT_COLUMNS = ["new_level", "new_idx", "key", "value", "tombstone", "ts"]


@query(f"WITH {RUNS}, {_cascade_sql(SHIPPED.lsm_max_level)} " + _KEPT.format(t=f"c{SHIPPED.lsm_max_level}"))
def compact_full(spark, sf_dir):
    return compaction.compact_full(kv_runs(spark, sf_dir), SHIPPED.lsm_max_level).select(*_KEPT_COLUMNS)


@query(f"WITH {RUNS}, {_cascade_sql(2)} " + _KEPT.format(t="c2"))
def compact_size_tiered(spark, sf_dir):
    return compaction.size_tiered(kv_runs(spark, sf_dir)).select(*_KEPT_COLUMNS)


COARSE_RUNS = f"{KV_COARSE}, {runs_sql()}"


@query(f"WITH {COARSE_RUNS} SELECT pair, key, value, tombstone, ts FROM (SELECT *, (idx - 1) // 2 AS pair, row_number() OVER (PARTITION BY (idx - 1) // 2, key ORDER BY ts DESC, idx DESC) AS kn FROM runs) WHERE kn = 1")
def merge_two_runs(spark, sf_dir):
    """Every two neighbouring runs."""
    runs = runs_of(kv_log_coarse(spark, sf_dir)).withColumn("pair", F.floor((F.col("idx") - 1) / 2))
    return compaction.merge(runs, ["pair", "key"]).select("pair", "key", "value", "tombstone", "ts")


@query(f"WITH {COARSE_RUNS} SELECT key, value, tombstone, ts FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, idx) AS kn FROM runs) WHERE kn = 1")
def merge_k_runs(spark, sf_dir):
    """All runs at once; ties go to the first of the list."""
    return compaction.merge(runs_of(kv_log_coarse(spark, sf_dir)), tie="first").select("key", "value", "tombstone", "ts")


def _two_levels(runs: DataFrame) -> DataFrame:
    """Older half of the runs as level 2, numbered from 1 each."""
    n = runs.agg(F.max("idx").alias("n")).first()["n"] or 0
    half = n // 2
    return runs.withColumn("level", F.when(F.col("idx") <= half, 2).otherwise(1)).withColumn("idx", F.when(F.col("idx") <= half, F.col("idx")).otherwise(F.col("idx") - half))


_TWO = "h AS (SELECT max(idx) // 2 AS h FROM runs), two AS (SELECT CASE WHEN idx <= h THEN 2 ELSE 1 END AS level, CASE WHEN idx <= h THEN idx ELSE idx - h END AS idx, key, value, tombstone, ts, seq FROM runs, h)"
_ENDS = "e AS (SELECT level, idx, min(key) AS f, max(key) AS l FROM two GROUP BY 1, 2)"
_MULT = SHIPPED.leveled_compaction_multiplier
_TAKEN = "hull AS (SELECT min(f) AS lo, max(l) AS hi FROM e WHERE level = 1), taken AS (SELECT level, idx FROM e WHERE level = 1 UNION ALL SELECT level, idx FROM e, hull WHERE level = 2 AND NOT (l < lo OR f > hi))"


@query(f"WITH {WIDE_RUNS}, {_TWO}, {_ENDS}, {_TAKEN} SELECT * FROM taken")
def leveled_candidates(spark, sf_dir):
    return compaction.leveled_candidates(_two_levels(_wide_runs(spark, sf_dir)), 1, _MULT)


@query(
    f"WITH {WIDE_RUNS}, {_TWO}, {_ENDS}, {_TAKEN}, m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, idx DESC) AS kn FROM two JOIN taken USING (level, idx)) WHERE kn = 1) "
    f"SELECT key, value, tombstone, ts, (row_number() OVER (ORDER BY key) - 1) // {SHIPPED.memtable_size} + 1 AS new_idx FROM m"
)
def compact_leveled(spark, sf_dir):
    return compaction.leveled(_two_levels(_wide_runs(spark, sf_dir)), 1, _MULT, SHIPPED.memtable_size)


@query(f"WITH {RUNS}, {_TWO}, {_cascade_sql(SHIPPED.lsm_max_level, 'two')} " + _KEPT.format(t=f"c{SHIPPED.lsm_max_level}"))
def compact_levels(spark, sf_dir):
    """Size-tiered compaction of a store that holds runs on two levels already."""
    return compaction.compact_full(_two_levels(kv_runs(spark, sf_dir)), SHIPPED.lsm_max_level).select(*_KEPT_COLUMNS)


_M40 = SHIPPED.memtable_size
_STEP = f"SELECT 2 AS level, (row_number() OVER (ORDER BY key) - 1) // {_M40} + 1 AS idx, key, value, tombstone, ts FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, level, idx DESC) AS kn FROM {{t}}) WHERE kn = 1"


@query(
    f"WITH {RUNS}, h AS (SELECT max(idx) // 2 AS h FROM runs), one AS ({_STEP.format(t='(SELECT r.* FROM runs r, h WHERE idx <= h)')}), "
    "two AS (SELECT level, idx, key, value, tombstone, ts FROM runs, h WHERE idx > h UNION ALL SELECT * FROM one), "
    f"{_ENDS}, {_TAKEN}, b AS (SELECT count(*) AS n FROM e, hull WHERE level = 2 AND l < lo), g AS (SELECT count(*) AS n FROM taken WHERE level = 2), "
    f"new AS ({_STEP.format(t='(SELECT two.* FROM two JOIN taken USING (level, idx))')}), made AS (SELECT max(idx) AS n FROM new), "
    "kept AS (SELECT two.* FROM two ANTI JOIN taken USING (level, idx)) "
    "SELECT level, idx + (SELECT n FROM b) AS idx, key, value, tombstone, ts FROM new UNION ALL SELECT level, CASE WHEN idx <= (SELECT n FROM b) THEN idx ELSE idx - (SELECT n FROM g) + (SELECT n FROM made) END, key, value, tombstone, ts FROM kept"
)
def compact_leveled_store(spark, sf_dir):
    """The store after leveled steps of level 1: the older half of the runs first, then the newer half on top of that."""
    runs = kv_runs(spark, sf_dir)
    half = (runs.agg(F.max("idx").alias("n")).first()["n"] or 0) // 2
    one = compaction.leveled_step(runs.filter(F.col("idx") <= half), 1, _MULT, _M40)
    later = runs.filter(F.col("idx") > half).withColumn("idx", F.col("idx") - half)  # a level's runs are numbered from 1
    return compaction.leveled_step(later.select(*one.columns).union(one), 1, _MULT, _M40)


@query(f"WITH {RUNS}, {_cascade_sql(2)}, k AS ({_KEPT.format(t='c2')}) SELECT new_level, new_idx, count(*) AS n_rows, count(*) FILTER (tombstone) AS n_tombstones FROM k GROUP BY 1, 2")
def tombstone_stats(spark, sf_dir):
    """Compaction keeps tombstones."""
    return compaction.size_tiered(kv_runs(spark, sf_dir)).groupBy("new_level", "new_idx").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("tombstone").alias("n_tombstones"))


@query(f"SELECT level, (pow(2, level - 1) * {SHIPPED.memtable_size})::BIGINT AS size_model, CASE WHEN level = 1 THEN 0 ELSE pow({_MULT}, level - 1)::BIGINT END AS capacity FROM (SELECT unnest(range(1, {SHIPPED.lsm_max_level + 1})) AS level)")
def level_capacity(spark, sf_dir):
    level = F.col("id")
    return spark.range(1, SHIPPED.lsm_max_level + 1).select(level.alias("level"), (F.pow(F.lit(2), level - 1) * SHIPPED.memtable_size).cast("long").alias("size_model"), F.when(level == 1, F.lit(0).cast("long")).otherwise(F.pow(F.lit(_MULT), level - 1).cast("long")).alias("capacity"))


# Sketches

SEED0 = 1_700_000_000
BM, BK = sketches.bloom_params(1000, 0.01)
CM, CK = sketches.cms_params(0.01, 0.01)
P = 10
_OKEY = "l_orderkey::VARCHAR"


def _order_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("item"))


def _brands(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("item"))


@query(f"SELECT p_partkey AS id, i, CASE i {' '.join(f'WHEN {i} THEN {hashing.bucket_sql('p_name', SEED0 + i, BM)}' for i in range(2))} END AS bucket_float, CASE i {' '.join(f'WHEN {i} THEN {hashing.bucket_sql('p_name', SEED0 + i, BM, 'int')}' for i in range(2))} END AS bucket_int FROM part, (SELECT unnest([0, 1]) AS i)")
def hash_buckets(spark, sf_dir):
    rows = []
    for i in range(2):
        rows.append(F.struct(F.lit(i).alias("i"), hashing.bucket(F.col("p_name"), SEED0 + i, BM).alias("bucket_float"), hashing.bucket(F.col("p_name"), SEED0 + i, BM, "int").alias("bucket_int")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array(*rows)).alias("r")).select("id", "r.*")


_SIZES = [(1000, 0.01), (100, 0.05), (40, 2.0), (20, 2.0)]


@query(f"SELECT n, p, m, ceil(m / n * ln(2))::BIGINT AS k FROM (SELECT n, p, ceil(n * abs(ln(p)) / pow(ln(2), 2))::BIGINT AS m FROM (VALUES {', '.join(f'({n}::BIGINT, {p}::DOUBLE)' for n, p in _SIZES)}) t(n, p))")
def bloom_params(spark, sf_dir):
    return spark.createDataFrame([(n, p, *sketches.bloom_params(n, p)) for n, p in _SIZES], "n long, p double, m long, k long")


def _sized(item: str, p: float = 0.01) -> str:
    """Bits of a filter for all distinct items, as a common table expression; the number of hash functions hardly depends on it."""
    return f"size AS (SELECT ceil(count(DISTINCT {item}) * abs(ln({p})) / pow(ln(2), 2))::BIGINT AS m FROM part)"


def _bits_sql(item: str, source: str, extra: str = "") -> str:
    return f"SELECT DISTINCT {extra}unnest([{', '.join(hashing.bucket_sql(item, SEED0 + i, '(SELECT m FROM size)') for i in range(BK))}]) AS bucket FROM {source}"


def _filter_size(items: DataFrame) -> tuple[int, int]:
    n = items.select("item").distinct().count()
    m, k = sketches.bloom_params(max(n, 1), 0.01)
    return m, k


def _part_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("item"), "p_brand")


_PART_NAME = "(p_name || '#' || p_partkey::VARCHAR)"


@query(f"WITH {_sized(_PART_NAME)} {_bits_sql(_PART_NAME, 'part')}")
def bloom_build(spark, sf_dir):
    """Over all of part, sized for its distinct items."""
    items = _part_names(spark, sf_dir)
    m, k = _filter_size(items)
    return sketches.bloom_build(items, m, k, SEED0)


@query(f"WITH {_sized(_PART_NAME)}, each AS ({_bits_sql(_PART_NAME, 'part', 'p_brand, ')}) SELECT p_brand AS grp, count(*) AS n_bits FROM each GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT bucket) FROM each")
def bloom_merge_by_group(spark, sf_dir):
    """Extension: a filter for each brand, and their union."""
    items = _part_names(spark, sf_dir)
    m, k = _filter_size(items)
    each = sketches.bloom_build(items, m, k, SEED0, groups=["p_brand"])
    count = F.count(F.lit(1)).alias("n_bits")
    return each.groupBy(F.col("p_brand").alias("grp")).agg(count).union(sketches.bloom_merge(each).agg(count).select(F.lit("all"), "n_bits"))


_PROBE = f"{_sized('p_brand')}, bits AS ({_bits_sql('p_brand', 'part')}), items AS (SELECT DISTINCT p_name AS item FROM part UNION SELECT DISTINCT p_brand FROM part), b AS (SELECT item, unnest([{', '.join(hashing.bucket_sql('item', SEED0 + i, '(SELECT m FROM size)') for i in range(BK))}]) AS bucket FROM items), probe AS (SELECT item, bool_and(bucket IN (SELECT bucket FROM bits)) AS maybe FROM b GROUP BY 1)"


def _probe(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    there = part.select(F.col("p_brand").alias("item"))
    m, k = _filter_size(there)
    items = part.select(F.col("p_name").alias("item")).union(there)
    return sketches.bloom_probe(items, sketches.bloom_build(there, m, k, SEED0), m, k, SEED0)


@query(f"WITH {_PROBE} SELECT * FROM probe")
def bloom_probe(spark, sf_dir):
    return _probe(spark, sf_dir)


@query(f"WITH {_PROBE}, truth AS (SELECT DISTINCT p_brand AS item FROM part) SELECT count(*) AS n_absent, count(*) FILTER (maybe) AS n_false_positive, (SELECT count(*) FROM probe JOIN truth USING (item) WHERE NOT maybe) AS n_false_negative FROM probe WHERE item NOT IN (SELECT item FROM truth)")
def bloom_fpr(spark, sf_dir):
    probe = _probe(spark, sf_dir)
    truth = table(spark, sf_dir, "part").select(F.col("p_brand").alias("item"), F.lit(True).alias("there")).distinct()
    rows = probe.join(truth, "item", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    return rows.agg(F.count_if(~F.col("there")).alias("n_absent"), F.count_if(~F.col("there") & F.col("maybe")).alias("n_false_positive"), F.count_if(F.col("there") & ~F.col("maybe")).alias("n_false_negative"))


_ERRORS = [(0.01, 0.01), (0.1, 0.1), (0.001, 0.01)]


@query(f"SELECT e AS epsilon, d AS delta, ceil(exp(1.0) / e)::BIGINT AS m, ceil(ln(exp(1.0) / d))::BIGINT AS k FROM (VALUES {', '.join(f'({e}::DOUBLE, {d}::DOUBLE)' for e, d in _ERRORS)}) t(e, d)")
def cms_params(spark, sf_dir):
    return spark.createDataFrame([(e, d, *sketches.cms_params(e, d)) for e, d in _ERRORS], "epsilon double, delta double, m long, k long")


def _cms_sql(mod: str) -> str:
    rows = " UNION ALL ".join(f"SELECT {i} AS row, {hashing.bucket_sql('item', SEED0 + i, CM, mod)} AS col, item FROM items" for i in range(CK))
    return f"items AS (SELECT p_brand AS item FROM part), h AS ({rows}), cms AS (SELECT row, col, count(*) AS cnt FROM h GROUP BY 1, 2)"


@query(f"WITH {_cms_sql('float')} SELECT * FROM cms")
def cms_build(spark, sf_dir):
    return sketches.cms_build(_brands(spark, sf_dir), CM, CK, SEED0)


@query(f"WITH {_cms_sql('float')} SELECT * FROM cms")
def cms_merge_by_group(spark, sf_dir):
    """Extension: a sketch for each part type, summed up to that of all."""
    items = table(spark, sf_dir, "part").select("p_type", F.col("p_brand").alias("item"))
    return sketches.cms_merge(sketches.cms_build(items, CM, CK, SEED0, groups=["p_type"]))


@query(f"WITH {_cms_sql('float')} SELECT item, min(cnt) AS estimate FROM (SELECT DISTINCT item, row, col FROM h) JOIN cms USING (row, col) GROUP BY 1")
def cms_estimate(spark, sf_dir):
    items = _brands(spark, sf_dir)
    return sketches.cms_estimate(items, sketches.cms_build(items, CM, CK, SEED0), CM, CK, SEED0)


@query(f"WITH {_cms_sql('int')}, est AS (SELECT item, min(cnt) AS estimate FROM (SELECT DISTINCT item, row, col FROM h) JOIN cms USING (row, col) GROUP BY 1), truth AS (SELECT item, count(*) AS n FROM items GROUP BY 1) SELECT count(*) AS n_items, max(estimate - n) AS worst, count(*) FILTER (estimate < n) AS n_under FROM est JOIN truth USING (item)")
def cms_error(spark, sf_dir):
    items = _brands(spark, sf_dir)
    est = sketches.cms_estimate(items, sketches.cms_build(items, CM, CK, SEED0, "int"), CM, CK, SEED0, "int")
    rows = est.join(items.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "item")
    return rows.agg(F.count(F.lit(1)).alias("n_items"), F.max(F.col("estimate") - F.col("n")).alias("worst"), F.count_if(F.col("estimate") < F.col("n")).alias("n_under"))


@query(f"SELECT o_orderkey AS id, {hashing.fnv1a32_sql('o_orderkey::VARCHAR')} AS h FROM orders")
def fnv1a32(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), hashing.fnv1a32(F.col("o_orderkey").cast("string")).alias("h"))


def _hll_sql(groups: str = "", source: str = "lineitem") -> str:
    low = f"(h & {(1 << 32 - P) - 1})"
    g = f"{groups}, " if groups else ""
    return f"hs AS (SELECT {g}{hashing.fnv1a32_sql(_OKEY)} AS h FROM {source}), reg AS (SELECT {g}h >> {32 - P} AS bucket, max(CASE WHEN {low} = 0 THEN {33 - P} ELSE 1 + bit_count(({low} & -{low}) - 1) END)::INT AS rank FROM hs GROUP BY {g}bucket)"


_M = 1 << P
_EST = f"""CASE WHEN raw <= {2.5 * _M} AND empty > 0 THEN {_M} * ln({_M} / empty) WHEN raw > {2**32 / 30} THEN -4294967296.0 * ln(1 - raw / 4294967296.0) ELSE raw END"""
_RAW = f"(SELECT {{g}}{0.7213 / (1 + 1.079 / _M) * _M * _M!r}::DOUBLE / (coalesce(sum(pow(2.0, -rank)), 0) + {_M} - count(*)) AS raw, {_M} - count(*) AS empty FROM reg {{by}})"


@query(f"WITH {_hll_sql()} SELECT * FROM reg")
def hll_registers(spark, sf_dir):
    return sketches.hll_registers(_order_keys(spark, sf_dir), P)


@query(f"WITH {_hll_sql()} SELECT round({_EST}, 6) AS estimate FROM " + _RAW.format(g="", by=""))
def hll_estimate(spark, sf_dir):
    return sketches.hll_estimate(sketches.hll_registers(_order_keys(spark, sf_dir), P), P)


@query(f"WITH {_hll_sql()}, e AS (SELECT {_EST} AS est FROM " + _RAW.format(g="", by="") + "), x AS (SELECT count(DISTINCT l_orderkey) AS exact FROM lineitem) SELECT exact, round(abs(est - exact) / exact, 6) < 0.1 AS close FROM e, x")
def hll_error(spark, sf_dir):
    items = _order_keys(spark, sf_dir)
    est = sketches.hll_estimate(sketches.hll_registers(items, P), P).first()["estimate"]  # one number
    exact = items.agg(F.count_distinct("item").alias("exact"))
    return exact.select("exact", (F.round(F.abs(F.lit(est) - F.col("exact")) / F.col("exact"), 6) < 0.1).alias("close"))


@query(f"WITH {_hll_sql('l_returnflag')} SELECT l_returnflag, round({_EST}, 6) AS estimate FROM " + _RAW.format(g="l_returnflag, ", by="GROUP BY 1") + f" UNION ALL SELECT 'all', round({_EST}, 6) FROM (SELECT {0.7213 / (1 + 1.079 / _M) * _M * _M!r}::DOUBLE / (coalesce(sum(pow(2.0, -rank)), 0) + {_M} - count(*)) AS raw, {_M} - count(*) AS empty FROM (SELECT bucket, max(rank) AS rank FROM reg GROUP BY 1))")
def hll_merge_by_group(spark, sf_dir):
    """Extension: a sketch for each group, and their union."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_orderkey").cast("string").alias("item"))
    registers = sketches.hll_registers(items, P, ["l_returnflag"])
    each = sketches.hll_estimate(registers, P, ["l_returnflag"])
    return each.union(sketches.hll_estimate(sketches.hll_merge(registers), P).select(F.lit("all"), "estimate"))


@query()
def spark_sketches(spark, sf_dir):
    """Spark's own sketches over the same items; other algorithms, so other estimates."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_orderkey").cast("string").alias("item"))
    each = items.groupBy("l_returnflag").agg(F.hll_sketch_agg("item", 12).alias("hll"))
    union = each.agg(F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("datasketches_hll_union"))
    whole = items.agg(
        F.approx_count_distinct("item").alias("approx_count_distinct"),
        F.hll_sketch_estimate(F.hll_sketch_agg("item", 12)).alias("datasketches_hll"),
        F.length(F.count_min_sketch("item", F.lit(0.01), F.lit(0.99), F.lit(7))).alias("count_min_sketch_bytes"),
        F.expr("approx_top_k(l_returnflag, 3)").alias("top_flags"),
    )
    return whole.join(union)  # one row each


_SJ = "'{{\"m\":{m},\"k\":{k},\"seed\":{s},' || "
_BRAND_BITS = f"bits AS (SELECT DISTINCT unnest([{', '.join(hashing.bucket_sql('p_brand', SEED0 + i, BM) for i in range(BK))}]) AS bucket FROM part)"


@query(
    f"WITH {_cms_sql('float')}, {_BRAND_BITS}, {_hll_sql()} "
    f"SELECT 'BloomFilterBrands' AS key, {_SJ.format(m=BM, k=BK, s=SEED0)} '\"bits\":[' || string_agg(bucket::VARCHAR, ',' ORDER BY bucket) || ']}}' AS value FROM bits "
    f"UNION ALL SELECT 'CountMinSketchBrands', {_SJ.format(m=CM, k=CK, s=SEED0)} '\"cells\":[' || string_agg('{{\"row\":' || row || ',\"col\":' || col || ',\"cnt\":' || cnt || '}}', ',' ORDER BY row, col) || ']}}' FROM cms "
    f"UNION ALL SELECT 'HyperLogLogOrders', '{{\"p\":{P},\"registers\":[' || string_agg('{{\"bucket\":' || bucket || ',\"rank\":' || rank || '}}', ',' ORDER BY bucket) || ']}}' FROM reg"
)
def sketch_values_stored(spark, sf_dir):
    """The text under which each sketch stands in the store."""
    log = _with_sketches(spark, sf_dir)
    return point.snapshot(log.filter(F.col("key").isin("BloomFilterBrands", "CountMinSketchBrands", "HyperLogLogOrders"))).select("key", "value")


def _with_sketches(spark, sf_dir) -> DataFrame:
    log, brands = kv_log(spark, sf_dir), _brands(spark, sf_dir)
    log = sketch_values.put(log, "BloomFilter", "Brands", sketch_values.bloom_value(sketches.bloom_build(brands.limit(0), BM, BK, SEED0), BM, BK, SEED0), 2_000_000_000)
    log = sketch_values.put(log, "BloomFilter", "Brands", sketch_values.bloom_value(sketches.bloom_build(brands, BM, BK, SEED0), BM, BK, SEED0), 2_000_000_001)
    log = sketch_values.put(log, "CountMinSketch", "Brands", sketch_values.cms_value(sketches.cms_build(brands, CM, CK, SEED0), CM, CK, SEED0), 2_000_000_001)
    return sketch_values.put(log, "HyperLogLog", "Orders", sketch_values.hll_value(sketches.hll_registers(_order_keys(spark, sf_dir), P), P), 2_000_000_001)


@query(
    f"WITH {_cms_sql('float')}, {_BRAND_BITS}, probes AS (SELECT DISTINCT p_brand AS item FROM part UNION SELECT DISTINCT p_name FROM part), pb AS (SELECT item, unnest([{', '.join(hashing.bucket_sql('item', SEED0 + i, BM) for i in range(BK))}]) AS bucket FROM probes), {_hll_sql()} "
    "SELECT 'bloom' AS sketch, item, CASE WHEN bool_and(bucket IN (SELECT bucket FROM bits)) THEN 1.0 ELSE 0.0 END::DOUBLE AS answer FROM pb GROUP BY item "
    "UNION ALL SELECT 'cms', item, min(cnt)::DOUBLE FROM (SELECT DISTINCT item, row, col FROM h) JOIN cms USING (row, col) GROUP BY item "
    f"UNION ALL SELECT 'hll', NULL, round({_EST}, 6)::DOUBLE FROM " + _RAW.format(g="", by="")
)
def sketch_values_asked(spark, sf_dir):
    """Stored sketches are read back from the log and answer as the ones that were put."""
    log, part = _with_sketches(spark, sf_dir), table(spark, sf_dir, "part")
    brands = part.select(F.col("p_brand").alias("item"))
    bloom = sketch_values.bloom_asks(log, "Brands", brands.union(part.select("p_name"))).select(F.lit("bloom").alias("sketch"), "item", F.col("maybe").cast("double").alias("answer"))
    cms = sketch_values.cms_asks(log, "Brands", brands).select(F.lit("cms"), "item", F.col("estimate").cast("double"))
    hll = sketch_values.hll_asks(log, "Orders").select(F.lit("hll"), F.lit(None).cast("string"), "estimate")
    return bloom.union(cms).union(hll)


_CAT = "all_ AS (SELECT seq, key, value, tombstone, ts FROM kv UNION ALL SELECT * FROM (VALUES (9000001, 'BloomFilterA', 'b1', false, 2000000001), (9000002, 'BloomFilterA', 'b2', false, 2000000002), (9000003, 'CountMinSketchC', 'c', false, 2000000001), (9000004, 'HyperLogLogH', 'h', false, 2000000001), (9000005, 'HyperLogLogH', '', true, 2000000002), (9000006, 'SimHashS', 's', false, 2000000001)) t(seq, key, value, tombstone, ts))"
_KIND = "CASE " + " ".join(f"WHEN starts_with(key, '{p}') THEN '{p}'" for p in point.RESERVED) + " ELSE 'value' END"


@query(f"WITH {KV}, {_CAT}, ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM all_), k AS (SELECT *, {_KIND} AS kind FROM ranked WHERE rn = 1 AND NOT tombstone) SELECT kind, CASE WHEN kind = 'value' THEN key ELSE substr(key, length(kind) + 1) END AS name, value, ts FROM k")
def sketch_catalog(spark, sf_dir):
    """Sketches put, replaced and deleted by name, beside ordinary keys."""
    rows = [(9000001, "BloomFilterA", "b1", False, 2000000001), (9000002, "BloomFilterA", "b2", False, 2000000002), (9000003, "CountMinSketchC", "c", False, 2000000001), (9000004, "HyperLogLogH", "h", False, 2000000001), (9000005, "HyperLogLogH", "", True, 2000000002), (9000006, "SimHashS", "s", False, 2000000001)]
    return catalog.entries(kv_log(spark, sf_dir).union(spark.createDataFrame(rows, "seq long, key string, value string, tombstone boolean, ts long")))


# SimHash

_UP = "replace(upper(replace(w, 'ß', chr(1))), chr(1), 'ß')"
_TOKENS = f"w AS (SELECT doc_id AS id, unnest(string_split(text, ' ')) AS w FROM documents), tok AS (SELECT id, trim(trim(trim(trim({_UP}, ','), '.'), '!'), '?') AS token, count(*) AS weight FROM w GROUP BY 1, 2)"


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"WITH {_TOKENS} SELECT * FROM tok")
def simhash_tokens(spark, sf_dir):
    return fingerprint.tokens(_texts(spark, sf_dir))


@query("SELECT DISTINCT p_brand AS token, array_to_string(list_transform(string_split(md5(p_brand), ''), lambda c: lpad(bin(ascii(c)), 8, '0')), '') AS bits FROM part")
def simhash_token_bits(spark, sf_dir):
    return fingerprint.token_bits(table(spark, sf_dir, "part").select(F.col("p_brand").alias("token")))


_FP = (
    _TOKENS + ", d AS (SELECT id, weight, md5(token) AS h FROM tok), c AS (SELECT id, weight, unnest(range(1, 33)) AS spot, ascii(substr(h, spot, 1)) AS code FROM d), "
    "s AS (SELECT id, spot, " + ", ".join(f"sum(CASE WHEN (code >> {7 - b}) & 1 = 1 THEN weight ELSE -weight END) AS s{b}" for b in range(8)) + " FROM c GROUP BY 1, 2), "
    "fp AS (SELECT id, string_agg(" + " || ".join(f"CASE WHEN s{b} > 0 THEN '1' ELSE '0' END" for b in range(8)) + ", '' ORDER BY spot) AS fingerprint FROM s GROUP BY 1)"
)


@query(f"WITH {_FP} SELECT * FROM fp")
def simhash_fingerprint(spark, sf_dir):
    return fingerprint.fingerprints(_texts(spark, sf_dir))


_HAMMING = "len(list_filter(list_zip(string_split(a.fingerprint, ''), string_split(b.fingerprint, '')), lambda z: z[1] <> z[2]))"


@query(f"WITH {_FP} SELECT a.id, {_HAMMING} AS distance FROM fp a JOIN fp b ON b.id = a.id + 1")
def simhash_hamming(spark, sf_dir):
    """Each document against the next one."""
    fp = checkpointed(fingerprint.fingerprints(_texts(spark, sf_dir)))
    b = fp.select((F.col("id") - 1).alias("id"), F.col("fingerprint").alias("other"))
    return fp.join(b, "id").select("id", fingerprint.hamming(fingerprint.words64(F.col("fingerprint")), fingerprint.words64(F.col("other"))).cast("long").alias("distance"))


_AGAIN = "again AS (SELECT id, array_to_string(list_transform(string_split(md5(fingerprint), ''), lambda c: lpad(bin(ascii(c)), 8, '0')), '') AS fingerprint FROM fp)"


@query(f"WITH {_FP}, {_AGAIN} SELECT a.id, {_HAMMING} AS distance FROM again a JOIN again b ON b.id = a.id + 1")
def simhash_compare_compat(spark, sf_dir):
    """The observable variant: each stored print is hashed once more as one token; equal prints still have distance 0."""
    fp = checkpointed(fingerprint.fingerprints(_texts(spark, sf_dir)))
    again = fp.select("id", fingerprint.normal(F.col("fingerprint")).alias("token"))
    bits = again.join(fingerprint.token_bits(again.select("token")), "token").select("id", "bits")
    b = bits.select((F.col("id") - 1).alias("id"), F.col("bits").alias("other"))
    return bits.join(b, "id").select("id", fingerprint.hamming(fingerprint.words64(F.col("bits")), fingerprint.words64(F.col("other"))).cast("long").alias("distance"))


NEAR = 12


@query(f"WITH {_FP}, u AS (SELECT DISTINCT fingerprint, " + ", ".join(f"substr(fingerprint, {64 * i + 1}, 64)::BIT AS w{i}" for i in range(4)) + f" FROM fp), p AS (SELECT a.fingerprint AS fp_a, b.fingerprint AS fp_b, ({' + '.join(f'bit_count(xor(a.w{i}, b.w{i}))' for i in range(4))})::BIGINT AS distance FROM u a JOIN u b ON a.fingerprint < b.fingerprint) SELECT * FROM p WHERE distance <= {NEAR}")
def simhash_near_dups(spark, sf_dir):
    fp = checkpointed(fingerprint.fingerprints(_texts(spark, sf_dir)))
    return fingerprint.near_pairs(fp, NEAR).withColumn("distance", F.col("distance").cast("long"))


# Integrity


def _merkle_sql(levels: int) -> str:
    """Leaves hashed, then pairs, up to a height that fits the largest tree."""
    out = "n0 AS (SELECT tree, pos, sha1(encode(data)) AS h FROM leaves)"
    for k in range(levels):
        out += f", n{k + 1} AS (SELECT tree, pos // 2 AS pos, sha1(unhex(max(CASE WHEN pos % 2 = 0 THEN h END)) || unhex(coalesce(max(CASE WHEN pos % 2 = 1 THEN h END), '{merkle.EMPTY}'))) AS h FROM n{k} GROUP BY tree, pos // 2)"
    return out + f" SELECT tree, h AS root FROM n{levels}"


_LEAVES = "leaves AS (SELECT idx AS tree, row_number() OVER (PARTITION BY idx ORDER BY key) - 1 AS pos, key || '=' || coalesce(value, '') AS data FROM runs)"


def _leaves(spark, sf_dir):
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("idx").orderBy("key")) - 1
    return kv_runs(spark, sf_dir).select(F.col("idx").alias("tree"), pos.cast("long").alias("pos"), F.concat("key", F.lit("="), F.coalesce("value", F.lit(""))).alias("data"))


@query(f"WITH {RUNS}, {_LEAVES}, " + _merkle_sql((CHUNK - 1).bit_length()))
def merkle_root(spark, sf_dir):
    return merkle.roots(_leaves(spark, sf_dir), CHUNK)


@query(f"WITH {RUNS}, {_LEAVES}, g AS (SELECT tree, count(*) AS n, max(CASE WHEN pos = 0 THEN data END) AS a, max(CASE WHEN pos = 1 THEN data END) AS b FROM leaves GROUP BY 1) SELECT tree, CASE n WHEN 1 THEN repeat('0', 40) WHEN 2 THEN sha1(encode(a || b)) ELSE '{merkle.EMPTY}' END AS root FROM g")
def merkle_root_compat(spark, sf_dir):
    return merkle.roots_compat(_leaves(spark, sf_dir))


@query("WITH leaves AS (SELECT 0::BIGINT AS tree, i - 1 AS pos, 'data ' || i AS data FROM (SELECT unnest(range(1, 101)) AS i)), " + _merkle_sql(7))
def merkle_file_root(spark, sf_dir):
    """A file of 100 lines, written, read back as text and hashed."""
    lines = spark.range(1, 101).select(F.format_string("%06d\tdata %d", F.col("id") - 1, F.col("id")).alias("value"))
    path = _scratch(lines)
    lines.write.text(path)
    parts = F.split("value", "\t")
    return merkle.roots(spark.read.text(path).select(F.lit(0).cast("long").alias("tree"), F.get(parts, F.lit(0)).cast("long").alias("pos"), F.get(parts, F.lit(1)).alias("data")), 100)


@query(f"WITH {RUNS}, {_LEAVES}, a AS (SELECT (tree - 1) // 2 AS pair, pos, sha1(encode(data)) AS hash_a FROM leaves WHERE tree % 2 = 1), b AS (SELECT (tree - 1) // 2 AS pair, pos, sha1(encode(data)) AS hash_b FROM leaves WHERE tree % 2 = 0) SELECT pair, pos, hash_a, hash_b FROM a FULL JOIN b USING (pair, pos) WHERE hash_a IS DISTINCT FROM hash_b")
def merkle_diff(spark, sf_dir):
    """Every two neighbouring trees."""
    leaves = _leaves(spark, sf_dir).withColumn("pair", F.floor((F.col("tree") - 1) / 2))
    return merkle.diff(leaves.filter("tree % 2 = 1"), leaves.filter("tree % 2 = 0"), ["pair"])


# Policies

_TB = f"""WITH RECURSIVE e AS (SELECT user_id AS principal, event_id AS id, epoch_us(ts) AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT principal, id, moment, n, ({{cap}} - 1)::BIGINT AS tokens, true AS admitted FROM e WHERE n = 1
          UNION ALL SELECT e.principal, e.id, e.moment, e.n, t - CASE WHEN t >= 1 THEN 1 ELSE 0 END, t >= 1
          FROM (SELECT e.principal, e.id, e.moment, e.n, least({{cap}}::BIGINT, f.tokens + floor({{rate}}::DOUBLE * ((e.moment - f.moment) / 1000000.0::DOUBLE))::BIGINT) AS t FROM f JOIN e ON e.principal = f.principal AND e.n = f.n + 1) e)
    SELECT principal, id, admitted FROM f"""


def _requests(spark, sf_dir):
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("principal"), at.alias("at"), F.col("event_id").alias("id"))


@query(_TB.format(cap=SHIPPED.token_cap, rate=SHIPPED.token_rate))
def token_bucket_admit(spark, sf_dir):
    return policy.token_bucket(_requests(spark, sf_dir), SHIPPED.token_cap, SHIPPED.token_rate)


_LRU = f"""a AS (SELECT event_id AS seq, user_id::VARCHAR AS key FROM events), p AS (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS prev, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS nxt FROM a),
    n AS (SELECT s.seq, count(x.seq) AS n FROM p s LEFT JOIN p x ON x.seq > s.prev AND x.seq < s.seq AND (x.nxt IS NULL OR x.nxt >= s.seq) GROUP BY 1), h AS (SELECT p.seq, p.key, p.prev IS NOT NULL AND n.n < {SHIPPED.lru_cap} AS hit FROM p JOIN n USING (seq))"""


def _accesses(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"))


@query(f"WITH {_LRU} SELECT * FROM h")
def lru_hits(spark, sf_dir):
    return policy.lru_hits(_accesses(spark, sf_dir), SHIPPED.lru_cap)


@query(f"WITH {_LRU} SELECT count(*) AS n, count(*) FILTER (hit) AS n_hits FROM h")
def lru_hit_rate(spark, sf_dir):
    return policy.lru_hits(_accesses(spark, sf_dir), SHIPPED.lru_cap).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_hits"))


# Utilities


def _gen_sql(tag: str) -> str:
    digest = f"md5('{tag}' || id::VARCHAR)"
    return " || ".join(f"chr((('0x' || substr({digest}, {2 * i + 1}, 2))::BIGINT % 26 + 97)::INT)" for i in range(5))


@query(f"SELECT id AS seq, {_gen_sql('k')} AS key, {_gen_sql('v')} AS value FROM (SELECT unnest(range(0, 1000)) AS id)")
def generate_entries(spark, sf_dir):
    return generate.entries(spark, 1000)


@query(f"WITH {KV}, {LIVE} SELECT key, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') AS written, 1800000000 - ts AS age FROM live")
def kv_age(spark, sf_dir):
    live = point.snapshot(kv_log(spark, sf_dir))
    written = F.expr("date_format(timestampadd(SECOND, ts, timestamp_ntz'1970-01-01 00:00:00'), 'yyyy-MM-dd HH:mm:ss')")
    return live.select("key", written.alias("written"), (F.lit(1_800_000_000) - F.col("ts")).alias("age"))


_KEYS = ["BloomFilterX", "bloomfilter", "SimHash", "HyperLogLog1", "CountMinSketch", "12", "1a", "", "a"]


@query(f"SELECT key, {_KIND} <> 'value' AS reserved, regexp_matches(key, '^[0-9]+$') AS \"numeric\", regexp_matches(key, '[0-9]') AS numeric_compat FROM (SELECT unnest([{', '.join(repr(k) for k in _KEYS)}]) AS key UNION ALL SELECT p_name FROM part)")
def key_validation(spark, sf_dir):
    keys = spark.createDataFrame([(k,) for k in _KEYS], "key string")
    return catalog.validate(keys.union(table(spark, sf_dir, "part").select("p_name")))
