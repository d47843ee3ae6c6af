"""Flush and compaction as plans over (level, idx, key, value, tombstone, ts, seq).

Of equal keys the greater ts stays; ties go to the newer run ("newest") or the first in the list ("first"). Of two runs the one on
the lower level is newer, and on one level that of the greater idx. Tombstones are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.views import newest
from .numbering import checkpointed, numbered


def merge(runs: DataFrame, keys: list[str] | None = None, tie: str = "newest") -> DataFrame:
    """One version of each key over all runs given (or for each of `keys`)."""
    if tie not in ("newest", "first"):
        raise ValueError(tie)
    sign = 1 if tie == "newest" else -1
    aged = runs.withColumn("up_", -sign * F.col("level")).withColumn("at_", sign * F.col("idx"))
    return newest(aged, keys or ["key"], ["ts", "up_", "at_"]).drop("up_", "at_")


def flush_chunked(log: DataFrame, size: int) -> DataFrame:
    """Segments of `size` arrivals."""
    return log.withColumn("segment", F.floor(F.col("seq") / size))


def flush_exact(log: DataFrame, size: int, shards: int = 1) -> DataFrame:
    """Segments that end when `size` distinct keys have been written since the last flush.

    A fold in order of arrival, so each shard of the log (by hash of the key) is one task; shards=1 is the single-store form. The
    shard streams by in sorted order, and the task holds up to `size` keys.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, seen, segment = None, set(), 0
        for b in batches:
            out = []
            for shard, key in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if shard != here:
                    here, seen, segment = shard, set(), 0
                out.append(segment)
                seen.add(key)
                if len(seen) == size:
                    seen, segment = set(), segment + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], ["shard", "seq", "key", "segment"])

    rows = log.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "seq", "key")
    return rows.repartition("shard").sortWithinPartitions("shard", "seq").mapInArrow(fold, "shard int, seq long, key string, segment long")


def _sizes(runs: DataFrame, levels: int) -> list[int]:
    """Runs of each level from 1 on; one number a level reaches the driver."""
    found = {r["level"]: r["n"] for r in runs.groupBy("level").agg(F.max("idx").alias("n")).collect()}
    return [found.get(lv, 0) for lv in range(1, levels + 1)]


def _paired(runs: DataFrame, first: int, last: int) -> DataFrame:
    """Pairs (1,2), (3,4), ... of level `first` move behind the runs of the next one, then those of that level, up to `last`."""
    sizes = _sizes(runs, last + 1)
    level, idx = F.col("level"), F.col("idx").cast("long")
    there = sizes[first - 1]
    for lv in range(first, last + 1):
        moves = (level == lv) & (idx <= there // 2 * 2)  # an odd last run stays, and becomes run 1
        level, idx = F.when(moves, lv + 1).otherwise(level), F.when(moves, sizes[lv] + F.ceil(idx / 2)).when(level == lv, 1).otherwise(idx).cast("long")
        there = sizes[lv] + there // 2
    placed = runs.withColumn("to_", F.struct(level.cast("int").alias("level"), idx.alias("idx")))
    return merge(placed.withColumn("new_level", F.col("to_.level")).withColumn("new_idx", F.col("to_.idx")).drop("to_"), ["new_level", "new_idx", "key"])


def size_tiered(runs: DataFrame, level: int = 1) -> DataFrame:
    """One level: runs (1,2), (3,4), ... are merged behind the runs of the next level; an odd last run stays and becomes run 1."""
    return _paired(runs, level, level)


def compact_full(runs: DataFrame, max_level: int) -> DataFrame:
    """Size-tiered compaction of every level below max_level, from 1 on upward, of a store that may hold runs on any level.

    Where each run ends follows from the levels' sizes, and pairwise merges of newest-wins are associative: one shuffle does it all.
    """
    return _paired(runs, 1, max_level - 1)


def capacity(level: int, multiplier: int) -> int:
    return 0 if level == 1 else multiplier ** (level - 1)


def _ends(runs: DataFrame) -> DataFrame:
    return runs.groupBy("level", "idx").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def _chosen(ends: DataFrame, level: int, multiplier: int) -> tuple[int, DataFrame]:
    """How many runs of the level are taken, and all runs with side: 0 taken, -1 and 1 below and above on the next level, else null."""
    n = ends.filter(F.col("level") == level).count()  # runs, not rows
    take = max(0, n - capacity(level, multiplier))
    own = (F.col("level") == level) & (F.col("idx") <= take)
    low, high = ends.filter(own).agg(F.min("first_key"), F.max("last_key")).first()  # the range of all taken runs together
    if low is None:
        return 0, ends.withColumn("side", F.lit(None).cast("int"))
    below = F.col("level") == level + 1
    side = F.when(own, 0).when(below & (F.col("last_key") < low), -1).when(below & (F.col("first_key") > high), 1).when(below, 0)
    return take, ends.withColumn("side", side.cast("int"))


def leveled_candidates(runs: DataFrame, level: int, multiplier: int) -> DataFrame:
    """(level, idx) of the runs that a leveled step takes: the first size - capacity of the level, and all of the next in their range."""
    return _chosen(_ends(runs), level, multiplier)[1].filter("side = 0").select("level", "idx")


def leveled(runs: DataFrame, level: int, multiplier: int, memtable_size: int, tie: str = "newest") -> DataFrame:
    """The rows that the step writes to level + 1, cut in key order into runs of memtable_size."""
    taken = runs.join(leveled_candidates(runs, level, multiplier), ["level", "idx"], "left_semi")
    rows = numbered(merge(taken, tie=tie).select("key", "value", "tombstone", "ts"), ["key"], "rn")
    return rows.withColumn("new_idx", F.floor((F.col("rn") - 1) / memtable_size) + 1).drop("rn")


def leveled_step(runs: DataFrame, level: int, multiplier: int, memtable_size: int) -> DataFrame:
    """The whole store (level, idx, key, value, tombstone, ts) after a leveled step.

    The merged runs stand where those that they replace stood, or in the gap that their range fits; what is left of the level
    moves to its start. A level's runs are numbered from 1. Levels from 2 on hold disjoint runs in order of their keys, as this step leaves them.
    """
    columns = ["level", "idx", "key", "value", "tombstone", "ts"]
    take, sides = _chosen(_ends(runs), level, multiplier)
    if not take:
        return runs.select(*columns)
    sides = checkpointed(sides.select("level", "idx", "side"))  # a row for each run
    marked = runs.join(sides, ["level", "idx"])
    rows = checkpointed(numbered(merge(marked.filter("side = 0")).select("key", "value", "tombstone", "ts"), ["key"], "rn"))
    made = -(-rows.count() // memtable_size)
    before, gone = sides.agg(F.count_if(F.expr("side = -1")), F.count_if((F.col("side") == 0) & (F.col("level") == level + 1))).first()
    new = rows.select(F.lit(level + 1).alias("level"), (F.floor((F.col("rn") - 1) / memtable_size) + 1 + before).alias("idx"), "key", "value", "tombstone", "ts")
    idx = F.when(F.col("level") == level, F.col("idx") - take).when(F.col("side") == 1, F.col("idx") - gone + made).otherwise(F.col("idx"))
    return marked.filter("side is null or side <> 0").withColumn("idx", idx.cast("long")).select(*columns).union(new)


def compact_leveled(runs: DataFrame, max_level: int, multiplier: int, memtable_size: int) -> DataFrame:
    """Leveled compaction of every level below max_level that is over its capacity, from 1 on upward: the store afterwards."""
    out = runs
    for level in range(1, max_level):
        if _sizes(out, level)[-1] > capacity(level, multiplier):
            out = checkpointed(leveled_step(out, level, multiplier, memtable_size))
    return out.select("level", "idx", "key", "value", "tombstone", "ts")
