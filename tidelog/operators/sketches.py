"""Bloom filter, Count-Min sketch and HyperLogLog as aggregates; sketches stay sparse tables until they are read."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import buckets, fnv1a32


def bloom_params(n: int, p: float) -> tuple[int, int]:
    if n < 1 or p <= 0 or p == 1:
        raise ValueError("n must be positive, and p neither 0 nor 1")
    m = math.ceil(n * abs(math.log(p)) / math.log(2) ** 2)
    return m, math.ceil(m / n * math.log(2))


def bloom_build(items: DataFrame, m: int, k: int, seed0: int, mod: str = "float", groups: list[str] | None = None) -> DataFrame:
    """(*groups, bucket): the set bits, at most m rows a group. Bits are deduplicated by the aggregate that combines before the shuffle."""
    groups = groups or []
    return items.select(*groups, F.explode(buckets(F.col("item"), k, m, seed0, mod)).alias("b")).select(*groups, "b.bucket").distinct()


def bloom_merge(bits: DataFrame) -> DataFrame:
    """Extension: the union of several filters of the same parameters."""
    return bits.select("bucket").distinct()


def bloom_probe(probes: DataFrame, bits: DataFrame, m: int, k: int, seed0: int, mod: str = "float") -> DataFrame:
    """(item, maybe) for distinct items. Items meet the set bits by an ordinary join, whose size decides whether the bits are broadcast."""
    rows = probes.select("item").distinct().select("item", F.explode(F.transform(buckets(F.col("item"), k, m, seed0, mod), lambda b: b["bucket"])).alias("bucket"))
    hit = rows.join(bits.select("bucket", F.lit(1).alias("set_")), "bucket", "left")
    return hit.groupBy("item").agg((F.count("set_") == F.count(F.lit(1))).alias("maybe"))


def cms_params(epsilon: float, delta: float) -> tuple[int, int]:
    if epsilon <= 0 or delta <= 0:
        raise ValueError("epsilon and delta must be positive")
    return math.ceil(math.e / epsilon), math.ceil(math.log(math.e / delta))


def cms_build(items: DataFrame, m: int, k: int, seed0: int, mod: str = "float", groups: list[str] | None = None) -> DataFrame:
    """(*groups, row, col, cnt): at most m * k rows a group. Equal items are counted first, so each is hashed once."""
    groups = groups or []
    counts = items.groupBy(*groups, "item").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.select(*groups, "n", F.explode(buckets(F.col("item"), k, m, seed0, mod)).alias("b"))
    return cells.groupBy(*groups, F.col("b.i").alias("row"), F.col("b.bucket").alias("col")).agg(F.sum("n").alias("cnt"))


def cms_merge(cells: DataFrame) -> DataFrame:
    """Extension: the sum of several sketches of the same parameters."""
    return cells.groupBy("row", "col").agg(F.sum("cnt").alias("cnt"))


def cms_estimate(probes: DataFrame, sketch: DataFrame, m: int, k: int, seed0: int, mod: str = "float") -> DataFrame:
    """(item, estimate). The sketch has at most m * k rows, so it's broadcast."""
    rows = probes.select("item").distinct().select("item", F.explode(buckets(F.col("item"), k, m, seed0, mod)).alias("b"))
    rows = rows.select("item", F.col("b.i").alias("row"), F.col("b.bucket").alias("col"))
    return rows.join(F.broadcast(sketch), ["row", "col"], "left").groupBy("item").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def hll_check(p: int) -> None:
    if not 4 <= p <= 16:
        raise ValueError("precision must be 4 to 16")


def hll_registers(items: DataFrame, p: int, groups: list[str] | None = None) -> DataFrame:
    """(*groups, bucket, rank): the greatest rank of each bucket that has any."""
    hll_check(p)
    groups = groups or []
    h = items.select(*groups, "item").distinct().select(*groups, fnv1a32(F.col("item")).alias("h"))  # each item is hashed once
    low = F.col("h").bitwiseAND(F.lit((1 << 32 - p) - 1))
    rank = F.when(low == 0, 33 - p).otherwise(1 + F.bit_count(low.bitwiseAND(-low) - 1))
    return h.select(*groups, F.shiftright("h", 32 - p).alias("bucket"), rank.cast("int").alias("rank")).groupBy(*groups, "bucket").agg(F.max("rank").alias("rank"))


def hll_estimate_of(p: int, total: Column, present: Column) -> Column:
    """total: sum of 2^-rank over the present buckets; absent ones count as 2^0."""
    m = 1 << p
    alpha = 0.7213 / (1 + 1.079 / m)
    empty = m - present
    raw = F.lit(alpha * m * m) / (total + empty)
    large = F.lit(float(2**32))
    return F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(m / empty)).when(raw > 2**32 / 30, -large * F.log(1 - raw / large)).otherwise(raw)


def hll_estimate(registers: DataFrame, p: int, groups: list[str] | None = None) -> DataFrame:
    """(*groups, estimate)."""
    hll_check(p)
    groups = groups or []
    total = registers.groupBy(*groups).agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("t_"), F.count(F.lit(1)).alias("n_"))
    return total.select(*groups, F.round(hll_estimate_of(p, F.col("t_"), F.col("n_")), 6).alias("estimate"))


def hll_merge(registers: DataFrame) -> DataFrame:
    """Extension: the union of several sketches' registers."""
    return registers.groupBy("bucket").agg(F.max("rank").alias("rank"))
