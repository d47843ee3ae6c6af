"""Merkle roots: nodes are hashed in pairs, level by level; every level is one aggregate over all trees at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMPTY = "da39a3ee5e6b4b0d3255bfef95601890afd80709"


#: Levels that one shuffle takes.
AT_ONCE = 8


def level_up(nodes: DataFrame, levels: int = 1) -> DataFrame:
    """(tree, pos, hash) to the ancestors `levels` up. A missing right child counts as the hash of nothing.

    The 2^levels nodes under an ancestor meet in one row, and are hashed there pair by pair.
    """
    nothing = F.unhex(F.lit(EMPTY))

    def pairs(row, _):
        parent = lambda i: F.unhex(F.sha1(F.concat(F.get(row, 2 * i), F.coalesce(F.get(row, 2 * i + 1), nothing))))
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(row) / 2).cast("int") - 1), parent)

    row = F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"])
    up = nodes.groupBy("tree", F.floor(F.col("pos") / (1 << levels)).alias("pos")).agg(row.alias("row"))
    return up.select("tree", "pos", F.get(F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.col("row"), pairs), F.lit(0)).alias("hash"))


def roots(leaves: DataFrame, most: int = 1) -> DataFrame:
    """leaves: (tree, pos, data), pos from 0 without gaps. (tree, root): leaves are hashed, then pairs.

    All trees are hashed up to the height of the largest, and to that of a tree of `most` leaves at least.
    """
    last = leaves.agg(F.max("pos").alias("n")).first()["n"] or 0  # one number
    height = max(int(last).bit_length(), (most - 1).bit_length())
    nodes = leaves.select("tree", "pos", F.unhex(F.sha1(F.col("data").cast("binary"))).alias("hash"))
    while height:
        step = min(AT_ONCE, height)
        nodes, height = level_up(nodes, step), height - step
    return nodes.select("tree", F.lower(F.hex("hash")).alias("root"))


def roots_compat(leaves: DataFrame) -> DataFrame:
    """The observable variant: one leaf has no hash, two have one of their data, and from three on all roots are that of nothing."""
    return leaves.groupBy("tree").agg(
        F.when(F.count(F.lit(1)) == 1, F.lit("0" * 40))
        .when(F.count(F.lit(1)) == 2, F.sha1(F.concat(F.max(F.when(F.col("pos") == 0, F.col("data"))), F.max(F.when(F.col("pos") == 1, F.col("data")))).cast("binary")))
        .otherwise(F.lit(EMPTY))
        .alias("root")
    )


def diff(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Extension. a, b: (*keys, pos, data). Positions whose leaves differ, with both hashes; a missing leaf has none."""
    on = [*(keys or []), "pos"]
    left = a.select(*on, F.sha1(F.col("data").cast("binary")).alias("hash_a"))
    right = b.select(*on, F.sha1(F.col("data").cast("binary")).alias("hash_b"))
    return left.join(right, on, "full_outer").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
