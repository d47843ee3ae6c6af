"""SimHash near-duplicates by generalised pigeonhole.

Fingerprints are linked at Hamming distance ``radius`` or less. The 64 bits are grouped into partitions of correlated bits, and
partition i gets a threshold t_i (-1: not probed, 0 or 1) with sum(t_i + 1) = radius + 1, so two fingerprints within the radius
are within t_i on some partition. Partitions of one plan have equal sizes, as near as may be; plans of several sizes compete. A dynamic programme picks the thresholds of the least estimated cost, from distances measured on
pairs of the fingerprints themselves. Fingerprints then meet in buckets (partition, masked bits) and are verified on all 64 bits.

Only distinct fingerprints are probed, so copies cost nothing. A bucket gives a spanning set of its links, never all pairs.
Buckets over ``BUCKET`` members are dealt out anew by a pigeonhole over their remaining bits, until all are small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Members that a bucket may have in one task's memory.
BUCKET = 20_000
#: Buckets up to this size are compared in full, larger ones by elimination.
SMALL = 32
#: Cost of one probe row in comparisons.
PROBE_COST = 200.0
#: Random partners of each fingerprint from which distances are estimated.
PARTNERS = 8
#: Tasks over which the members of one component are dealt.
SALTS = 16
#: Shingles hashed at once.
CHUNK = 100_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = (text or b"").lower().split()  # bytes: lowers A-Z only, splits at space and 0x09-0x0D
    if not words:
        return 0
    flat, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[: len(words) - k] + 1)).tolist()
    stops = ends[k - 1 :].tolist()
    n, ones = len(stops), np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        h = np.frombuffer(b"".join([digest(flat[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], stops[i : i + CHUNK], strict=True)]), np.uint8)
        ones += np.unpackbits(h.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint_of(hashes: np.ndarray) -> int:
    """Fingerprint of hashes that are at hand already, as a signed long: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as a signed long. Null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):  # few texts as Python objects at a time
                part = b.slice(at, 256)
                fps = np.array([fingerprint(t, shingle) for t in part.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _fps(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def co_occurrence(distinct: DataFrame) -> tuple[np.ndarray, int]:
    """How many distinct fingerprints have both bits i and j set, and how many there are; 2,080 sums reach the driver."""
    upper = np.triu_indices(64)

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            bits = np.unpackbits(_fps(b).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            total, n = total + bits.T @ bits, n + len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2081)), pa.array(np.append(total[upper], n).astype(np.int64))], ["cell", "n"])

    sums = {r["cell"]: r["n"] for r in distinct.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    both = np.zeros((64, 64))
    both[upper] = [sums.get(i, 0) for i in range(2080)]
    return both + np.triu(both, 1).T, int(sums.get(2080, 0))


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of bits; each starts at the strongest correlation left and takes the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for g in range(m):
        size = len(left) // (m - g)
        rest = sorted(left)
        first = rest[int(np.argmax(corr[np.ix_(rest, rest)].max(axis=1)))]
        group = [first]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].sum(axis=1)))])
        groups.append(sorted(group))
        left -= set(group)
    return groups


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def near_chance(distinct: DataFrame, both: np.ndarray, n: int, plans: list[list[list[int]]]) -> dict[tuple[int, int, int], float]:
    """Chance that two fingerprints differ in exactly d (0 or 1) bits of group g of plan k.

    Measured on PARTNERS pairs for every fingerprint; not below what independent bits would give.
    """
    cells = [(k, g, d, _mask(bits)) for k, plan in enumerate(plans) for g, bits in enumerate(plan) for d in (0, 1)]

    def run(batches):
        hits, pairs = np.zeros(len(cells), np.int64), 0
        for b in batches:
            fp = _fps(b)
            for s in range(1, PARTNERS + 1):
                if len(fp) > s:
                    x = fp[s:] ^ fp[:-s]
                    pairs += len(x)
                    hits += np.array([(np.bitwise_count(x & np.uint64(mask)) == d).sum() for _, _, d, mask in cells])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells) + 1)), pa.array(np.append(hits, pairs).astype(np.int64))], ["cell", "n"])

    # in order of a hash, so that neighbours are random pairs
    shuffled = distinct.select("fp").sortWithinPartitions(F.xxhash64("fp"))
    sums = {r["cell"]: r["n"] for r in shuffled.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    pairs = max(sums.get(len(cells), 0), 1)
    p = np.diag(both) / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 1e-6, 0.5)
    out = {}
    for i, (k, g, d, _) in enumerate(cells):
        q = differ[plans[k][g]]
        none = float(np.prod(1 - q))
        out[k, g, d] = max(sums.get(i, 0) / pairs, none if d == 0 else none * float(np.sum(q / (1 - q))))
    return out


def allocate(cost: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) = total and the least summed cost, by dynamic programming. cost[i][t] for each allowed t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in cost:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, ts) in best.items():
            for t, more in options.items():
                key, value = spent + t + 1, (c + more, [*ts, t])
                if key <= total and (key not in after or value < after[key]):
                    after[key] = value
        best = after
    return best[total]


def probe_masks(groups: list[list[int]], thresholds: list[int]) -> list[int]:
    """Masks of the bits kept in a bucket key. At threshold 1 each bit of the group is left out in turn."""
    masks = []
    for bits, t in zip(groups, thresholds, strict=True):
        if t == 0:
            masks.append(_mask(bits))
        elif t == 1:
            masks += [_mask(bits) & ~(1 << b) for b in bits]
    return masks


def plan_probes(distinct: DataFrame, radius: int = RADIUS) -> list[int]:
    both, n = co_occurrence(distinct)
    plans = [group_bits(both, n, m) for m in range((radius + 2) // 2, radius + 2)]
    chance = near_chance(distinct, both, n, plans)
    found = []
    for k, groups in enumerate(plans):
        pairs = n * n / 2
        cost = [
            {-1: 0.0, 0: PROBE_COST * n + pairs * chance[k, g, 0], 1: PROBE_COST * n * len(bits) + pairs * (len(bits) * chance[k, g, 0] + chance[k, g, 1])}
            for g, bits in enumerate(groups)
        ]
        c, thresholds = allocate(cost, radius + 1)
        found.append((c, probe_masks(groups, thresholds)))
    return min(found)[1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _spanning(fp: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all of fp that is connected: each member found takes what it reaches out of the rest."""
    out, rest = [], fp
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), x), found))
                front.extend(found)
                rest = rest[~near]
    return out


def bucket_links(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal group."""
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(edges, len(group)))
    a, b = [], []
    each = np.repeat(sizes, sizes)
    small = (each > 1) & (each <= SMALL)
    g, f = group[small], fp[small]
    for s in range(1, int(each[small].max(initial=1))):
        near = (g[s:] == g[:-s]) & (np.bitwise_count(f[s:] ^ f[:-s]) <= radius)
        a.append(f[:-s][near])
        b.append(f[s:][near])
    for at, size in zip(edges[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        for x, y in _spanning(fp[at : at + size], radius):
            a.append(x)
            b.append(y)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _probe(rows: DataFrame, radius: int, bucket: int) -> DataFrame:
    """rows: (mask, key, fp). Links (a, b), and the members of buckets over `bucket` as (mask, key, fp) with a null."""

    def run(batches):
        names = ["a", "b", "mask", "key", "fp"]

        def links(mask, key, fp):
            group = np.cumsum(np.concatenate(([0], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])))) if len(fp) else np.zeros(0, np.int64)
            a, b = (x.view(np.int64) for x in bucket_links(group, fp.view(np.uint64), radius))
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, none], names)

        def over(mask, key, fp):
            none = pa.nulls(len(fp), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(mask), pa.array(key), pa.array(fp)], names)

        held = [np.zeros(0, np.int64)] * 3
        large = None  # the bucket whose members go straight through
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if large is not None and len(new[2]):
                same = (new[0] == large[0]) & (new[1] == large[1])
                if same.any():
                    yield over(*(x[same] for x in new))
                    new = [x[~same] for x in new]
                if not same.all():
                    large = None
            mask, key, fp = (np.concatenate(x) for x in zip(held, new, strict=True))
            if not len(fp):
                held = [mask, key, fp]
                continue
            starts = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))))
            sizes = np.diff(np.append(starts, len(fp)))
            big = np.repeat(sizes > bucket, sizes)
            if sizes[-1] > bucket:
                large = (mask[-1], key[-1])
            if big.any():
                yield over(mask[big], key[big], fp[big])
            last = len(fp) if sizes[-1] > bucket else int(starts[-1])
            ready = ~big[:last]
            yield links(mask[:last][ready], key[:last][ready], fp[:last][ready])
            held = [mask[last:], key[last:], fp[last:]]
        if len(held[2]):
            yield links(*held)

    dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(run, "a long, b long, mask long, key long, fp long")


def _split_masks(mask: int, radius: int) -> list[int]:
    """The bucket's mask with each of radius + 1 parts of the other bits."""
    rest = [b for b in range(64) if not mask >> b & 1]
    return [mask | _mask(rest[i :: radius + 1]) for i in range(radius + 1)]


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links of distinct fingerprints (column fp) that connect all that lies within the radius, step by step."""
    masks = plan_probes(distinct, radius)
    spark = distinct.sparkSession
    cut = F.array(*[F.lit(_signed(m)) for m in sorted(masks)])
    rows = distinct.select(F.explode(cut).alias("mask"), "fp").select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
    found = None
    while True:
        out = checkpointed(_probe(rows, radius, bucket))
        linked = out.filter("a is not null").select("a", "b")
        found = linked if found is None else found.union(linked)
        large = out.filter("a is null").select("mask", "key", "fp")
        level = sorted({r["mask"] for r in large.select("mask").distinct().collect()})  # at most the masks of this level
        if not level:
            return found
        finer = spark.createDataFrame([(m, _signed(x)) for m in level for x in _split_masks(m % (1 << 64), radius)], "mask long, finer long")
        rows = large.join(F.broadcast(finer), "mask").select(F.col("finer").alias("mask"), F.col("finer").bitwiseAND(F.col("fp")).alias("key"), "fp").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id.

    Null, empty and blank texts have fingerprint zero, which is linked like any other. Repeated rows each have a row. A null
    doc_id takes part, but names no component: where no member has an id, component_id is null. An empty table gives an empty
    result. Other columns of docs are not read.
    """
    by_doc = checkpointed(fingerprints(docs, id_col, text_col))
    distinct = checkpointed(by_doc.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(distinct, radius, bucket))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp").withColumn("salt", F.pmod("fp", F.lit(SALTS)).cast("int"))
    # The members of a large component meet its least id in SALTS tasks.
    least = linked.groupBy("root").agg(F.min("first").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = linked.join(least, ["root", "salt"]).select("fp", "component_id", F.lit(True).alias("linked"))
    named = distinct.join(placed, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"))
    return by_doc.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
