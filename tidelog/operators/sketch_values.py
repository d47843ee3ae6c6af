"""Sketches as stored values: to text, into the log under a reserved name, back, and asked again.

A value is the JSON of a sketch's parameters and its sparse state in order, so equal sketches have equal values. State is bounded
by the parameters (m bits, m x k counters, 2^p registers, 256 bits), not by the items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketches
from .point import RESERVED, snapshot

BLOOM = "struct<m:bigint,k:bigint,seed:bigint,bits:array<bigint>>"
CMS = "struct<m:bigint,k:bigint,seed:bigint,cells:array<struct<row:int,col:bigint,cnt:bigint>>>"
HLL = "struct<p:bigint,registers:array<struct<bucket:bigint,rank:int>>>"
KINDS = dict(zip(RESERVED, (BLOOM, CMS, HLL, "struct<fingerprint:string>"), strict=True))


def _value(state: DataFrame, **parameters) -> DataFrame:
    """state: one row, one column."""
    return state.select(F.to_json(F.struct(*[F.lit(v).cast("long").alias(k) for k, v in parameters.items()], *state.columns)).alias("value"))


def bloom_value(bits: DataFrame, m: int, k: int, seed0: int) -> DataFrame:
    return _value(bits.agg(F.array_sort(F.collect_set(F.col("bucket").cast("long"))).alias("bits")), m=m, k=k, seed=seed0)


def cms_value(sketch: DataFrame, m: int, k: int, seed0: int) -> DataFrame:
    cell = F.struct(F.col("row").cast("int").alias("row"), F.col("col").cast("long").alias("col"), F.col("cnt").cast("long").alias("cnt"))
    return _value(sketch.agg(F.array_sort(F.collect_list(cell)).alias("cells")), m=m, k=k, seed=seed0)


def hll_value(registers: DataFrame, p: int) -> DataFrame:
    cell = F.struct(F.col("bucket").cast("long").alias("bucket"), F.col("rank").cast("int").alias("rank"))
    return _value(registers.agg(F.array_sort(F.collect_list(cell)).alias("registers")), p=p)


def simhash_value(fingerprint: DataFrame) -> DataFrame:
    """fingerprint: one row (fingerprint)."""
    return _value(fingerprint.select("fingerprint"))


def put(log: DataFrame, kind: str, name: str, value: DataFrame, ts: int) -> DataFrame:
    """The log with the sketch as the newest version of its name. value: one row (value)."""
    if kind not in RESERVED:
        raise ValueError(kind)
    last = log.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("seq")).first()["seq"]
    row = value.select(F.lit(last).cast("long").alias("seq"), F.lit(kind + name).alias("key"), "value", F.lit(False).alias("tombstone"), F.lit(ts).cast("long").alias("ts"))
    return log.unionByName(row.select(*log.columns))


def get(log: DataFrame, kind: str, name: str) -> DataFrame:
    """The live sketch's parameters and state as columns; no row if there is none."""
    rows = snapshot(log.filter(F.col("key") == kind + name))
    return rows.select(F.from_json("value", KINDS[kind]).alias("s")).select("s.*")


def _stored(log: DataFrame, kind: str, name: str) -> tuple[DataFrame, dict] | None:
    rows = get(log, kind, name)
    fixed = [c for c in rows.columns if c in ("m", "k", "seed", "p")]
    first = rows.select(*fixed).first()  # a few numbers
    return (rows, first.asDict()) if first else None


def bloom_asks(log: DataFrame, name: str, probes: DataFrame) -> DataFrame | None:
    """sketches.bloom_probe against a stored filter; None if there is none."""
    if not (found := _stored(log, "BloomFilter", name)):
        return None
    rows, p = found
    return sketches.bloom_probe(probes, rows.select(F.explode("bits").alias("bucket")), p["m"], p["k"], p["seed"])


def cms_asks(log: DataFrame, name: str, probes: DataFrame) -> DataFrame | None:
    if not (found := _stored(log, "CountMinSketch", name)):
        return None
    rows, p = found
    return sketches.cms_estimate(probes, rows.select(F.inline("cells")), p["m"], p["k"], p["seed"])


def hll_asks(log: DataFrame, name: str) -> DataFrame | None:
    if not (found := _stored(log, "HyperLogLog", name)):
        return None
    rows, p = found
    return sketches.hll_estimate(rows.select(F.inline("registers")), p["p"])
