"""PUT, DELETE, GET and the snapshot over an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.views import newest

RESERVED = ("BloomFilter", "CountMinSketch", "HyperLogLog", "SimHash")


def _one(log: DataFrame, key: str, value: str, tombstone: bool, ts: int) -> DataFrame:
    row = log.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(value).alias("value"), F.lit(tombstone).alias("tombstone"), F.lit(ts).cast("long").alias("ts"))
    last = log.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("seq")).first()["seq"]
    return row.withColumn("seq", F.lit(last).cast("long")).select(*log.columns)


def put(log: DataFrame, key: str, value: str, ts: int) -> DataFrame:
    if key.startswith(RESERVED):
        raise ValueError(f"reserved prefix: {key}")
    return log.unionByName(_one(log, key, value, False, ts))


def delete(log: DataFrame, key: str, ts: int) -> DataFrame:
    """A tombstone, whether the key exists or not."""
    return log.unionByName(_one(log, key, "", True, ts))


def snapshot(log: DataFrame) -> DataFrame:
    """The live version of each key: the newest by ts, then seq. Tombstones are dropped after, not before."""
    return newest(log, ["key"], ["ts", "seq"]).filter(~F.col("tombstone")).select("key", "value", "ts")


def as_of(log: DataFrame, ts: int) -> DataFrame:
    """Extension: the snapshot as it was at a time."""
    return snapshot(log.filter(F.col("ts") <= ts))


def get(log: DataFrame, key: str) -> DataFrame:
    """One row or none. The key reaches the scan as a pushed filter."""
    return snapshot(log.filter(F.col("key") == key))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Extension: get() for the keys of a table."""
    return snapshot(log.join(keys.select("key").distinct(), "key", "left_semi"))


def source_rank(policy: str = "size_tiered"):
    """Column that orders runs from newest to oldest: by level, then idx descending (leveled: ascending from level 2 on)."""
    idx = -F.col("idx") if policy == "size_tiered" else F.when(F.col("level") == 1, -F.col("idx")).otherwise(F.col("idx"))
    return F.struct(F.col("level").alias("level"), idx.alias("idx"))


def find(runs: DataFrame, policy: str = "size_tiered") -> DataFrame:
    """The version of each key in its newest run; tombstones are returned, too."""
    first = F.min_by(F.struct("level", "idx", "value", "tombstone", "ts"), source_rank(policy))
    return runs.groupBy("key").agg(first.alias("r")).select("key", "r.*")
