"""What a run's index, summary and point lookup would show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entry import size
from ..functions.hashing import buckets
from .sketches import bloom_params


def index(runs: DataFrame) -> DataFrame:
    """(level, idx, key, offset): where each entry starts in its run."""
    before = Window.partitionBy("level", "idx").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select("level", "idx", "key", F.coalesce(F.sum(size(F.col("key"), F.col("value"))).over(before), F.lit(0)).alias("offset"))


def summary(runs: DataFrame, interval: int) -> DataFrame:
    """Every interval-th key of a run, with the run's first and last key."""
    run = Window.partitionBy("level", "idx")
    rows = runs.select("level", "idx", "key", F.row_number().over(run.orderBy("key")).alias("rn"), F.min("key").over(run).alias("first_key"), F.max("key").over(run).alias("last_key"))
    return rows.filter((F.col("rn") - 1) % interval == 0).select("level", "idx", "key", "first_key", "last_key", F.floor((F.col("rn") - 1) / interval).alias("slot"))


def level_sizes(runs: DataFrame, max_level: int) -> DataFrame:
    """(level, n_runs) for every level, empty ones too."""
    levels = runs.sparkSession.range(1, max_level + 1).select(F.col("id").cast("int").alias("level"))
    sizes = runs.groupBy("level").agg(F.count_distinct("idx").alias("n"))
    return levels.join(sizes, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n_runs"))


def find_trace(runs: DataFrame, key: str, p: float, seed0: int, n: int) -> DataFrame:
    """For each run the gate that a lookup of the key stops at: bloom, range, index, or hit. n: keys that the filters are made for."""
    m, k = bloom_params(n, p)
    want = {r["bucket"] for r in runs.sparkSession.range(1).select(F.explode(buckets(F.lit(key), k, m, seed0)).alias("b")).select("b.bucket").collect()}
    bits = F.transform(buckets(F.col("key"), k, m, seed0), lambda b: b["bucket"])
    wanted = F.array(*[F.lit(b) for b in sorted(want)])
    # Each row gives the wanted bits it sets as a small number; they are combined by OR, so nothing but a few bits is shuffled.
    mask = F.aggregate(F.sequence(F.lit(0), F.lit(len(want) - 1)), F.lit(0), lambda acc, i: acc.bitwiseOR(F.when(F.array_contains(bits, F.get(wanted, i)), F.expr("1")).otherwise(0) * F.pow(F.lit(2), i).cast("int")))
    runs_ = runs.select("level", "idx", "key", mask.alias("mask")).groupBy("level", "idx")
    ends = runs_.agg(F.bit_or("mask").alias("mask"), F.min("key").alias("f"), F.max("key").alias("l"), F.max(F.col("key") == key).alias("has"))
    full = (1 << len(want)) - 1
    gate = F.when(F.col("mask") != full, "bloom").when((F.col("f") > key) | (F.col("l") < key), "range").when(~F.col("has"), "index").otherwise("hit")
    return ends.select("level", "idx", gate.alias("gate"))
