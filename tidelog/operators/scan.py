"""Range and prefix scans, in pages.

A key is seen at its newest version. Pages go by source (newest run first), then key, and are numbered from 1; page 0 is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import checkpointed, numbered
from .point import find


def visible(runs: DataFrame) -> DataFrame:
    """The newest version of each key, without deleted keys. Filters on key may be pushed below; others must not."""
    return find(runs).filter(~F.col("tombstone")).drop("tombstone")


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Page `number` of visible rows, with pos over the whole scan. Only the rows up to the page's end are ordered."""
    if number < 1:
        return rows.withColumn("pos", F.lit(0)).limit(0)
    order = [F.col("level"), F.col("idx").desc(), F.col("key")]
    top = rows.orderBy(*order).limit(number * size)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order))).filter(F.col("pos") > (number - 1) * size)


def range_scan(runs: DataFrame, low: str, high: str, number: int, size: int) -> DataFrame:
    return page(visible(runs.filter(F.col("key").between(low, high))), number, size)


def prefix_scan(runs: DataFrame, prefix: str, number: int, size: int) -> DataFrame:
    return page(visible(runs.filter(F.startswith(F.col("key"), F.lit(prefix)))), number, size)


def bounds(pages: DataFrame) -> DataFrame:
    """pages: (number, size). First and last row number; page 0 ends at 0."""
    return pages.withColumn("first_row", F.when(F.col("number") < 1, 1).otherwise((F.col("number") - 1) * F.col("size") + 1)).withColumn("last_row", F.greatest(F.lit(0), F.col("number") * F.col("size")))


#: Places of the order of all run bounds that are joined as one block; tasks over which the runs that span a block are dealt; pairs a task.
BLOCK, SALTS, TASK_PAIRS = 1024, 16, 4_000_000


def spans(runs: DataFrame) -> DataFrame:
    """(idx, from_, to_): the places of each run's first and last key in the order of all of them; equal keys: first ones before last ones."""
    ends = runs.groupBy("level", "idx").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key")).filter(F.col("first_key").isNotNull())
    marks = F.array(F.struct(F.col("first_key").alias("key"), F.lit(0).alias("last")), F.struct(F.col("last_key").alias("key"), F.lit(1).alias("last")))
    placed = numbered(ends.select("level", "idx", F.explode(marks).alias("m")).select("level", "idx", "m.key", "m.last"), ["key", "last"])
    return checkpointed(placed.groupBy("level", "idx").agg(F.min("pos").alias("from_"), F.max("pos").alias("to_")).select("idx", "from_", "to_"))


def overlaps(runs: DataFrame) -> DataFrame:
    """Pairs of runs whose key ranges meet: of two such runs, one begins within the other.

    Each run meets the runs that begin in the blocks which it spans. But for its first and last block these are its pairs, so the work
    follows the result.
    """
    found = spans(runs)
    most = found.agg(F.sum(F.col("to_") - F.col("from_")).alias("n")).first()["n"] or 0
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
    a = found.select(F.col("idx").alias("idx_a"), "from_", "to_", F.explode(F.sequence(block("from_"), block("to_"))).alias("block"), F.pmod("from_", F.lit(SALTS)).alias("salt"))
    b = found.select(F.col("idx").alias("idx_b"), F.col("from_").alias("at_"), block("from_").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")).alias("salt"))
    tasks = int(most // TASK_PAIRS) + 1
    a, b = (x.repartition(tasks, "block", "salt") for x in (a, b))
    met = a.join(b.hint("merge"), ["block", "salt"]).filter((F.col("at_") > F.col("from_")) & (F.col("at_") <= F.col("to_")) & (F.col("idx_a") != F.col("idx_b")))
    return met.select(F.least("idx_a", "idx_b").alias("idx_a"), F.greatest("idx_a", "idx_b").alias("idx_b"))
