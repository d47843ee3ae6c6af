"""Hierarchical weighted hash tree: documents descend region, rack and shard by weighted hash draws.

At each level every child draws ``-ln(u) / weight`` with u from a hash of key and child name, and the least draw wins. A
key's draw at a child depends on that child alone, so a changed weight moves keys only between its subtree and the others,
never among the others. ``grow`` hangs a new shard as its own region below the root: all old subtrees keep their weights, so
rows move only into the new shard (law ``key``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

ROW_OVERHEAD = 8


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(n: int, racks: int = 2, per_rack: int = 4) -> tuple[Shard, ...]:
    """n shards of weight 1, filled rack by rack."""
    return tuple(Shard(f"region{s // (racks * per_rack)}", f"rack{s // per_rack % racks}", s) for s in range(n))


def grow(shards: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """One more shard, in a region of its own."""
    new = max((s.shard for s in shards), default=-1) + 1
    return (*shards, Shard(f"grown{new}", "rack0", new, weight))


def _least(key: Column, children: Column) -> Column:
    """`at` of the child with the least draw; ties go to the smaller `at`. children: array of (name, weight, at)."""

    def draw(c: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, c["name"]), 11) + 1) / F.lit(float(2**53))
        return F.struct((-F.log(u) / c["weight"]).alias("draw"), c["at"].alias("at"))

    return F.array_min(F.transform(children, draw))["at"]


def _literal(rows: list[tuple[str, float, int]]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(w)).alias("weight"), F.lit(at).alias("at")) for name, w, at in rows])


def shard_of(key: Column, shards: tuple[Shard, ...]) -> Column:
    """Shard number of a key. A null key is hashed like any other value."""
    if not shards:
        raise ValueError("no shards")
    if any(s.weight <= 0 for s in shards):
        raise ValueError("weights must be positive")
    tops: dict[str, dict[str, list[Shard]]] = {}
    for s in shards:
        tops.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    regions, racks, leaves = [], [], []
    for region, inner in tops.items():
        regions.append((region, sum(s.weight for group in inner.values() for s in group), len(racks)))
        own = []
        for rack, group in inner.items():
            own.append((f"{region}/{rack}", sum(s.weight for s in group), len(leaves)))
            leaves.append([(f"{region}/{rack}/{s.shard}", s.weight, s.shard) for s in group])
        racks.append(own)
    # Each level draws among the children of the node that the level above chose, and of no other.
    region = _least(key, _literal(regions))
    rack = _least(key, F.get(F.array(*map(_literal, racks)), region))
    return _least(key, F.get(F.array(*map(_literal, leaves)), rack))


def number_in_shards(placed: DataFrame, order: list[str]) -> DataFrame:
    """Adds slot: gapless from 0 in each shard, by `order`.

    Rows are range-partitioned by shard and order, so a hot shard or a hot text is spread over many tasks; a small table of
    (partition, shard) counts gives each partition its offset. That table has at most partitions + shards rows, so it's broadcast.
    """
    ranged = placed.repartitionByRange(F.col("shard"), *[F.col(c) for c in order]).sortWithinPartitions("shard", *order)
    rows = checkpointed(ranged.withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("_part", "shard").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", "shard", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return rows.join(F.broadcast(parts), ["_part", "shard"]).withColumn("slot", F.col("_at") - F.col("_first") + F.col("_offset")).drop("_at", "_part", "_first", "_offset")


def shard_documents(docs: DataFrame, shards: tuple[Shard, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Null text: size 8, crc32 of empty text. Equal texts of a shard take neighbouring slots. Repeated rows are each placed, in
    the same shard, with slots of their own. An empty table gives an empty result. Other columns of docs are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    placed = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_group"),
        shard_of(key, shards).alias("shard"),
        shard_of(key, grow(shards)).alias("grown_shard"),
    )
    numbered = number_in_shards(placed, ["_group", "text_crc32", "size", "doc_id"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
