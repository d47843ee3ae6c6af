"""Key/value logs over the sample tables.

kv_log (seq LONG, key STRING, value STRING, tombstone BOOLEAN, ts LONG): seq is the order of arrival, ts whole seconds.
kv_runs (level INT, idx LONG, key, value, tombstone, ts, seq): sorted runs; a greater idx of level 1 is newer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: str):
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        F.col("props").alias("value"),
        (F.col("event_type") == "error").alias("tombstone"),
        epoch_seconds("ts").alias("ts"),
    )


def kv_log_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts in days: many versions of a key tie."""
    return kv_log(spark, sf_dir).withColumn("ts", F.floor(F.col("ts") / 86400))


def kv_log_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many keys and prefixes."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"),
        F.concat("p_name", F.lit("#"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("key"),
        F.col("p_type").alias("value"),
        (F.col("p_size") % 7 == 0).alias("tombstone"),
        F.col("p_partkey").alias("ts"),
    )


def newest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row by `order` for each of `keys`: an aggregate that combines before the shuffle, not a window."""
    rest = [c for c in log.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return log.groupBy(*keys).agg(last.alias("r_")).select(*keys, *[F.col(f"r_.{c}").alias(c) for c in rest]).select(*log.columns)


def runs_of(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The log cut into level-1 runs of `chunk` arrivals; each holds the newest version of its keys."""
    cut = log.select(F.lit(1).alias("level"), (F.floor(F.col("seq") / chunk) + 1).alias("idx"), "key", "value", "tombstone", "ts", "seq")
    return newest(cut, ["level", "idx", "key"], ["ts", "seq"])


def kv_runs(spark: SparkSession, sf_dir: str, chunk: int = CHUNK) -> DataFrame:
    return runs_of(kv_log(spark, sf_dir), chunk)


#: The same views as DuckDB common table expressions.
KV = """kv AS (SELECT event_id AS seq, 'u' || lpad(user_id::VARCHAR, 6, '0') AS key, props AS value, event_type = 'error' AS tombstone, floor(epoch(ts))::BIGINT AS ts FROM events)"""
KV_COARSE = KV.replace("floor(epoch(ts))::BIGINT AS ts", "floor(floor(epoch(ts)) / 86400)::BIGINT AS ts")
WIDE = """kv AS (SELECT p_partkey AS seq, p_name || '#' || lpad(p_partkey::VARCHAR, 7, '0') AS key, p_type AS value, p_size % 7 = 0 AS tombstone, p_partkey AS ts FROM part)"""


def runs_sql(chunk: int = CHUNK) -> str:
    return f"""runs AS (SELECT 1 AS level, idx, key, value, tombstone, ts, seq FROM (
        SELECT *, seq // {chunk} + 1 AS idx, row_number() OVER (PARTITION BY seq // {chunk}, key ORDER BY ts DESC, seq DESC) AS rn FROM kv) WHERE rn = 1)"""
