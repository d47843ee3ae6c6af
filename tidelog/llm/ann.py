"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are grown on a bounded sample, then every vector is filed in one leaf of each. A query walks all trees through one
priority queue ordered by margin, and collects the leaves that the queue gives up first; how many is set on the sample, so that
its own searches reach TARGET recall. Rows and queries meet leaf by leaf, and candidates are ranked by their exact inner product.

A leaf of many rows or many queries is dealt out as a grid of tasks: each holds a bounded block of rows, and queries stream by.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 20
#: Trees grow with the table: a leaf holds about LEAF_ROWS of its rows, and LEAST_LEAF rows of the sample at least.
TREES, LEAF_ROWS, LEAST_LEAF = 3, 1500, 4
#: Bounds of the sample on which trees are grown, and of the queries on which the number of leaves is set.
SAMPLE_ROWS, SAMPLE_QUERIES = 10_000, 100
TARGET = 0.94
#: Rows held, and queries seen, by one task of a leaf.
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 200_000
BATCH = 256
#: By how much a rough score may be off, as a share of the product of the vectors' lengths.
EPS = 1e-12


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays: normal, threshold and the two children; a child below 0 is leaf -1 - child."""

    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray

    def leaves(self) -> int:
        return len(self.normals) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), 0 if len(self.normals) else -1)
        while (at := np.flatnonzero(out >= 0)).size:
            node = out[at]
            side = np.einsum("ij,ij->i", x[at], self.normals[node]) > self.cuts[node]
            out[at] = self.children[node, side.astype(int)]
        return -1 - out


def grow(sample: np.ndarray, rng: np.random.Generator, depth: int, least: int = LEAST_LEAF) -> Tree:
    """Each node splits its rows at the median of a random projection, if it can."""
    normals, cuts, children, leaves = [], [], [], 0

    def node(rows: np.ndarray, left: int) -> int:
        nonlocal leaves
        w = rng.standard_normal(sample.shape[1]) if sample.size else np.zeros(0)
        p = sample[rows] @ w if len(rows) else np.zeros(0)
        cut = np.median(p) if len(rows) else 0.0
        if left == 0 or len(rows) < 2 * least or not (p > cut).any():
            leaves += 1
            return -leaves
        me = len(normals)
        normals.append(w / np.linalg.norm(w))
        cuts.append(cut / np.linalg.norm(w))
        children.append([0, 0])
        children[me] = [node(rows[p <= cut], left - 1), node(rows[p > cut], left - 1)]
        return me

    node(np.arange(len(sample)), depth)
    dims = sample.shape[1] if sample.ndim == 2 else 0
    return Tree(np.array(normals, float).reshape(len(normals), dims), np.array(cuts), np.array(children, int).reshape(-1, 2))


def visits(trees: list[Tree], q: np.ndarray, most: int) -> list[int]:
    """The leaves of all trees (numbered through) that one shared priority queue gives up first."""
    base = np.cumsum([0, *[t.leaves() for t in trees]])
    heap, out = [], []
    for t, tree in enumerate(trees):
        heap.append((-np.inf, t, 0 if len(tree.normals) else -1))
    sides = [tree.normals @ q - tree.cuts for tree in trees]
    heapq.heapify(heap)
    while heap and len(out) < most:
        worst, t, n = heapq.heappop(heap)
        while n >= 0:
            m = sides[t][n]
            near, far = (1, 0) if m > 0 else (0, 1)
            heapq.heappush(heap, (max(worst, abs(m)), t, int(trees[t].children[n, far])))
            n = int(trees[t].children[n, near])
        out.append(int(base[t]) - 1 - n)
    return out


def visits_for_recall(trees: list[Tree], sample: np.ndarray, k: int, target: float) -> int:
    """The fewest leaves with which the sample's own searches reach the recall."""
    total = sum(t.leaves() for t in trees)
    if len(sample) <= k + 1:
        return total
    base = np.cumsum([0, *[t.leaves() for t in trees]])
    filed = np.stack([t.assign(sample) + b for t, b in zip(trees, base, strict=False)])
    queries = np.arange(min(SAMPLE_QUERIES, len(sample)))
    score = sample[queries] @ sample.T
    score[queries, queries] = -np.inf
    best = np.argpartition(-score, k, axis=1)[:, :k]
    reached = np.zeros(total + 1)
    for q in queries:
        turn = np.full(total, total + 1)
        order = visits(trees, sample[q], total)
        turn[order] = np.arange(len(order)) + 1
        first = turn[filed[:, best[q]]].min(axis=0)
        reached += np.bincount(first, minlength=total + 1)[: total + 1]
    recall = np.cumsum(reached) / (len(queries) * k)
    return int(np.argmax(recall >= target)) if (recall >= target).any() else total


@dataclass(frozen=True)
class Forest:
    trees: list[Tree]
    visits: int

    def cells(self, x: np.ndarray) -> np.ndarray:
        base = np.cumsum([0, *[t.leaves() for t in self.trees]])
        return np.stack([t.assign(x) + b for t, b in zip(self.trees, base, strict=False)], axis=1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec): rows with an id whose vector isn't null, empty or zero, and has no null or non-finite component.

    Vectors that aren't of the commonest length (of equally common ones, the greatest) can't be compared, and take no part.
    """
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    usual = rows.groupBy(F.size("vec").alias("dims")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "dims"))["dims"].alias("dims")).first()["dims"]
    return rows.filter(F.size("vec") == F.lit(usual or 0))


def depth_for(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    """So many levels that a leaf holds about leaf_rows of the table's rows."""
    return max(1, round(math.log2(max(rows, 1) / leaf_rows))) if rows > leaf_rows else 1


def fit(rows: DataFrame, seed: int = 11, trees: int = TREES, depth: int | None = None, k: int = K, target: float = TARGET) -> Forest:
    """Grown on about SAMPLE_ROWS different rows, picked by a hash of their ids."""
    n = rows.count()
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    got = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20)).distinct().limit(2 * SAMPLE_ROWS).collect()
    got.sort(key=lambda r: (hash(r["id"]), r["vec"]))
    rng = np.random.default_rng(seed)
    sample = np.array([r["vec"] for r in got]) if got else np.zeros((0, 0))
    sample = sample[rng.permutation(len(sample))]
    grown = [grow(sample, rng, depth or depth_for(n)) for _ in range(trees)]
    return Forest(grown, visits_for_recall(grown, sample, k, target))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _filed(rows: DataFrame, forest: Forest, asks: bool) -> DataFrame:
    """(cell, id, vec): a row for each tree (asks: for each leaf that the query visits)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = _matrix(part.column(1))
                cells = [visits(forest.trees, q, forest.visits) for q in x] if asks else forest.cells(x).tolist()
                at_ = np.repeat(np.arange(len(x)), [len(c) for c in cells])
                out = part.take(pa.array(at_))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, int), *map(np.array, cells)]).astype(np.int64)), out.column(0), out.column(1)], ["cell", "id", "vec"])

    return rows.select("id", "vec").mapInArrow(run, "cell long, id long, vec array<double>")


def _least_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k + 1 rows with the least ids of each set of equal vectors: a query's k best hold no others. Repeated rows count once."""
    order = np.lexsort((ids, *x.T[::-1]))
    same = lambda o: np.concatenate(([False], (x[o[1:]] == x[o[:-1]]).all(axis=1)))
    order = order[~(same(order) & np.concatenate(([False], ids[order[1:]] == ids[order[:-1]])))]
    start = np.maximum.accumulate(np.where(same(order), 0, np.arange(len(order))))
    return order[np.arange(len(order)) - start <= k]


def best_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """Each query's k best (-score, id) among the rows, without rows of its own id. A score that overflows both ways is the least."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = np.nan_to_num(q @ x.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        longest = np.sqrt((x * x).sum(axis=1)).max()
        off = np.nan_to_num(EPS * x.shape[1] * np.sqrt((q * q).sum(axis=1)) * longest, posinf=np.inf)
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    out = []
    take = min(2 * k + 4, len(ids))
    top = np.argpartition(-rough, take - 1, axis=1)[:, :take]
    for i in range(len(q)):
        at = top[i]
        s = rough[i, at]
        kth = np.partition(-s, min(k, take) - 1)[min(k, take) - 1]
        least = -kth - off[i] if np.isfinite(off[i]) else -np.inf
        if take < len(ids) and s.min() >= least:  # ties may go on
            at = np.flatnonzero(rough[i] >= least)
        at = at[ids[at] != q_ids[i]]
        with np.errstate(over="ignore", invalid="ignore"):
            exact = np.nan_to_num((q[i] * x[at]).sum(axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)  # the same sum for equal vectors, wherever they stand
        order = np.lexsort((ids[at], -exact))[:k]
        out.append([(-float(exact[j]), int(ids[at[j]])) for j in order])
    return out


def _ranked(met: DataFrame, k: int) -> DataFrame:
    """met: (cell, a, b, ask, id, vec), in order of cell, a, b, ask. Gives (query_id, best)."""

    def run(batches):
        here, blocks, ids, x = None, [], None, None
        for batch in batches:
            where = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]], axis=1)
            cut = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1 if len(where) else np.zeros(0, int)
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(where)], strict=True):
                if a == z:
                    continue
                part = batch.slice(a, z - a)
                own, vec = part.column(4).to_numpy(zero_copy_only=False), _matrix(part.column(5))
                if here != (spot := tuple(where[a, :3])):
                    here, blocks, ids = spot, [], None
                if not where[a, 3]:
                    blocks.append((own, vec))
                    continue
                if ids is None:
                    if not blocks:
                        continue
                    ids, x = (np.concatenate(c) for c in zip(*blocks, strict=True))
                    keep = _least_copies(ids, x, k)
                    ids, x, blocks = ids[keep], x[keep], []
                for at in range(0, len(own), BATCH):
                    found = best_of(own[at : at + BATCH], vec[at : at + BATCH], ids, x, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[at : at + BATCH]), pa.array([[{"s": s, "id": i} for s, i in f] for f in found], pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64())])))], ["query_id", "best"]
                    )

    return met.mapInArrow(run, "query_id long, best array<struct<s:double,id:long>>")


def search(rows: DataFrame, queries: DataFrame, forest: Forest, k: int = K, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best found among rows, but not those of its own id.

    rows and queries: (id, vec) as usable() gives them. Equal scores go to the smaller id; a repeated row counts once, as a
    candidate and as a query. Where an id has several vectors, each is a candidate, and its queries share one list. Empty tables
    give an empty result.
    """
    filed, asked = _filed(rows, forest, False), _filed(queries.select("id", "vec").distinct(), forest, True)
    # Both counts have one row for each leaf of the forest.
    n = {r["cell"]: r["n"] for r in filed.select("cell").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    m = {r["cell"]: r["n"] for r in asked.select("cell").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = sorted(n.keys() & m.keys())
    if not cells:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = lambda counts, size: F.element_at(F.create_map(*[F.lit(y) for c in cells for y in (c, -(-counts[c] // size))]), F.col("cell"))
    down, across = parts(n, block_rows), parts(m, block_queries)

    def grid(side, own, other, first, ask):
        own_part = F.pmod(F.xxhash64("id"), own).cast("int")
        all_parts = F.explode(F.sequence(F.lit(0), other.cast("int") - 1))
        side = side.filter(F.col("cell").isin(cells)).withColumn("own_", own_part).withColumn("other_", all_parts)
        a, b = ("own_", "other_") if first else ("other_", "own_")
        return side.select("cell", F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), F.lit(ask).cast("long").alias("ask"), "id", "vec")

    met = grid(filed, down, across, True, 0).union(grid(asked, across, down, False, 1))
    met = met.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b", "ask")
    best = _ranked(met, k).groupBy("query_id").agg(F.flatten(F.collect_list("best")).alias("all"))  # at most visits x tasks x k entries a query
    # In order, what several leaves or trees gave alike stands side by side.
    fresh = lambda a: F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))
    first = F.get(F.transform(F.array(F.sort_array("all")), lambda a: F.slice(fresh(a), 1, k)), F.lit(0))
    best = best.select("query_id", first.alias("best"))
    out = best.select("query_id", F.posexplode("best").alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.s")).alias("score"))
