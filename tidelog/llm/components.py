"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's greater neighbours (large), or the node and its lesser ones (small), to the least of them.

    A row for each row taken, at most; some may repeat.
    """
    if large:
        ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
        near = edges.select(F.explode(ends).alias("e")).select("e.u", "e.v")
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        return near.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
    return near.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))


def _is_star(edges: DataFrame) -> bool:
    """Whether each node of the distinct edges (a, b), b < a, has one edge, or is the b of all its edges."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))
    up = edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
    return up.filter("up > 1 or (up = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node reachable. All state stays in checkpoints."""
    edges = checkpointed(edges.select("a", "b").filter("a <> b").distinct())
    for _ in range(max_rounds):
        edges = checkpointed(_star(_star(edges, True), False).distinct())
        if _is_star(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
