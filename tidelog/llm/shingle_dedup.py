"""Near-duplicates by exact Jaccard similarity of word shingles: five words, 0.8 or more.

A text is the set of its five-word shingles. Sets have SimHash fingerprints, which op7's generalised pigeonhole links; the sets of
linked fingerprints are compared, and the similar ones are the first components. A similarity of 0.8 leaves fingerprints further
apart than any radius that pigeonhole can serve, so links between components that remain are found exactly, as follows.

Shingles are put into one global order, common ones last. Two sets of Jaccard
similarity t or more share a shingle among the first n - ceil(t n) + 1 of each (prefix filtering), so texts that share such a
shingle are candidates; their sizes and the place of the shingle rule many of them out. Each set also has a bitmap, a bit for
each shingle's place flipped once per shingle: bitmaps of two sets differ in no more bits than the sets do in shingles, so those
that differ in too many bits can't be similar. The full sets decide on what is left. The order is only a matter of speed:
whatever it is, no pair is lost.

One shuffle carries the shingles of all prefixes and the rows' own names and bitmaps; nothing else of the size of the texts is
written.

Equal sets are one node. The members of buckets over ``SMALL`` meet again with their bitmaps, and give pairs that connect what
the bitmaps connect. Where these pairs, once decided, leave a bucket in several components, member after member is held against
those of other components, until the bucket has given ``GIVEN`` pairs for each member; what is left goes on when they are decided.
So large groups of copies don't give all their pairs, and no pair is given that the bitmaps rule out.
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
from .simhash_dedup import CHUNK, RADIUS, SEED, fingerprint_of, links

SHINGLE = 5
#: Documents from which common shingles are learned, and how many shingles at most count as common.
SAMPLE_DOCS = 10_000
COMMON = 100_000
#: Buckets up to this size are compared in full.
SMALL = 32
#: Pairs for each member that a larger bucket gives in a round.
GIVEN = 8
#: Bits of the filter that sets pass on their way to the comparison.
FILTER_BITS = 1 << 22


def shingles(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; shorter texts are one shingle, blank ones have none."""
    words = (text or b"").lower().split()  # bytes: lowers A-Z only, splits at space and 0x09-0x0D
    if not words:
        return np.zeros(0, np.uint64)
    flat, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(k, len(words))
    starts = np.concatenate(([0], ends[: len(words) - k] + 1)).tolist()
    stops = ends[k - 1 :].tolist()
    found = []
    for i in range(0, len(stops), CHUNK):
        found.append(np.unique(np.frombuffer(b"".join([digest(flat[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], stops[i : i + CHUNK], strict=True)]), np.uint64)))
    return np.unique(np.concatenate(found))


def node_of(hashes: np.ndarray) -> int:
    """Name of a set, as a signed long."""
    x = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in batches:
        for at in range(0, b.num_rows, 256):  # few texts as Python objects at a time
            part = b.slice(at, 256)
            yield part, [shingles(t) for t in part.column(column).cast(pa.binary()).to_pylist()]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Sorted hashes that several texts of a sample hold, with their ranks from 1 (least common) in the second row."""
    share = SAMPLE_DOCS / max(texts.count(), 1)

    def run(batches):
        for _, sets in _texts(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], ["h"])

    sample = texts if share >= 1 else texts.sample(share, SEED)
    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    top = counts.orderBy(F.desc("n"), "h").limit(COMMON).collect()
    hashes = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return np.stack([hashes[order], (len(top) - order).astype(np.uint64)])


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles of the order."""
    n = len(hashes)
    rank = np.zeros(n, np.uint64)
    if n and common.shape[1]:
        at = np.minimum(np.searchsorted(common[0], hashes), common.shape[1] - 1)
        rank = np.where(common[0][at] == hashes, common[1][at], rank)
    return hashes[np.lexsort((hashes, rank))[: n - (4 * n + 4) // 5 + 1]]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def bitmap(hashes: np.ndarray) -> bytes:
    """A power of two of bits, 4 to 8 for each shingle; a bit is the parity of the shingles that fall on it."""
    size = max(64, 4 << max(len(hashes) - 1, 0).bit_length())
    return np.packbits((np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool)).tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ, the larger one folded onto the smaller: at most the sets' symmetric difference."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


CELL = "key long, place long, node long, doc_id long, text_hash long, bits binary, fp long"


def cells(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """CELL: (key, place, node) for each shingle of a prefix, and for each row, dealt out by its number, its names and its set's size, bitmap and fingerprint.

    A place is size << 32 | position. Copies within a task give the cells of one.
    """
    names = [x.split()[0] for x in CELL.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        seen: set[int] = set()
        count = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for part, sets in _texts(batches, 2):
            named = [node_of(s) for s in sets]
            size = np.array([len(s) for s in sets], np.int64) << 32
            spread = np.frombuffer(b"".join(xxhash.xxh64_digest((count + i).to_bytes(8, "big")) for i in range(len(sets))), np.int64)
            count += len(sets)
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(size), pa.array(named, pa.int64()), part.column(0), part.column(1), pa.array(list(map(bitmap, sets)), pa.binary()), pa.array([fingerprint_of(s) for s in sets], pa.int64())], names)
            fresh = [i for i, x in enumerate(named) if not (x in seen or seen.add(x))]
            keys = [prefix(sets[i], common).view(np.int64) for i in fresh]
            lengths = [len(k) for k in keys]
            flat = np.concatenate([np.zeros(0, np.int64), *keys])
            place = np.concatenate([np.zeros(0, np.int64), *(size[i] + np.arange(n) for i, n in zip(fresh, lengths, strict=True))])
            none = pa.nulls(len(flat), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(place), pa.array(np.repeat(np.array([named[i] for i in fresh], np.int64), lengths)), none, none, pa.nulls(len(flat), pa.binary()), none], names)

    return rows.mapInArrow(run, CELL)


def may_match(place_a: np.ndarray, place_b: np.ndarray) -> np.ndarray:
    """Whether sets that share a shingle, and none before it, can be similar."""
    na, nb, pa_, pb = place_a >> 32, place_b >> 32, place_a & 0xFFFFFFFF, place_b & 0xFFFFFFFF
    return (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)) & (9 * np.minimum(na - pa_, nb - pb) >= 4 * (na + nb))


class Bitmaps:
    """The bitmaps of a bucket's members, as a matrix for each length."""

    def __init__(self, bits: list[bytes]):
        self.bits = bits
        self.length = np.array([len(x) // 8 for x in bits])
        self.row = np.zeros(len(bits), np.int64)
        self.rows = {}
        for n in np.unique(self.length).tolist():
            at = np.flatnonzero(self.length == n)
            self.row[at] = np.arange(len(at))
            self.rows[n] = np.frombuffer(b"".join(bits[i] for i in at.tolist()), np.uint64).reshape(len(at), n)

    def apart(self, p: int, others: np.ndarray) -> np.ndarray:
        """In how many bits the others' bitmaps differ from that of member p, the longer one folded."""
        out = np.zeros(len(others), np.int64)
        own, length = np.frombuffer(self.bits[p], np.uint64), self.length[others]
        for n, rows in self.rows.items():
            at = np.flatnonzero(length == n)
            if len(at):
                x = rows[self.row[others[at]]]
                if n <= len(own):
                    x = x ^ np.bitwise_xor.reduce(own.reshape(-1, n), axis=0)
                else:
                    x = np.bitwise_xor.reduce(x.reshape(len(x), -1, len(own)), axis=1) ^ own
                out[at] = np.bitwise_count(x).sum(axis=1)
        return out


def _spanning_of(place: np.ndarray, node: np.ndarray, bits: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Pairs that connect all members of a bucket which their bitmaps connect, step by step; and the members of any pair."""
    maps, size, out = Bitmaps(bits), place >> 32, []
    rest, left = np.argsort(node, kind="stable"), np.zeros(len(node), bool)
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            p = front.pop()
            may = np.flatnonzero(may_match(place[rest], place[p]))
            near = may[9 * maps.apart(p, rest[may]) <= size[rest[may]] + size[p]]
            if len(near):
                found = rest[near]
                out.append((node[found], np.full(len(found), node[p])))
                left[found] = left[p] = True
                front.extend(found.tolist())
                rest = np.delete(rest, near)
    return out, left


def _pairs_of(place: np.ndarray, node: np.ndarray, root: np.ndarray, bits: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Candidate pairs (member, pivot) of a bucket, and which of its members remain to be compared with each other."""
    left = np.ones(len(node), bool)
    roots, inverse, sizes = np.unique(root, return_inverse=True, return_counts=True)
    if len(roots) == 1:
        return [], ~left
    order = np.argsort(node, kind="stable")
    first = np.zeros(len(node), bool)
    first[order[np.unique(inverse[order], return_index=True)[1]]] = True
    # one of each component first, then what isn't in the largest: without those, all are connected
    fill = order[~first[order] & (inverse[order] != int(np.argmax(sizes)))]
    maps, size, out, given = Bitmaps(bits), place >> 32, [], 0
    for p in np.concatenate((order[first[order]], fill)).tolist():
        if given >= GIVEN * len(node):
            break
        left[p] = False
        near = left & (root != root[p])
        near[near] = may_match(place[near], place[p])
        if near.any():
            others = np.flatnonzero(near)
            others = others[9 * maps.apart(p, others) <= size[others] + size[p]]
            given += len(others)
            if len(others):
                out.append((node[others], np.full(len(others), node[p])))
    if len(np.unique(root[left])) < 2:
        left[:] = False
    return out, left


def _meet(rows: DataFrame, spanning: bool = False) -> DataFrame:
    """rows: CELL at first, then (key, place, node, root, bits) of large buckets; spanning: with the pairs that connect them.

    Gives candidate pairs (a, b), the members of large buckets that are left as (key, place, node) with nulls, and the rows' own
    cells as they are.
    """
    names = ["a", "b", *(x.split()[0] for x in CELL.split(", "))]
    later = "root" in rows.columns

    def out(n, **columns):
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, pa.binary() if c == "bits" else pa.int64()) for c in names], names)

    def over(key, place, node):
        return out(len(key), key=pa.array(key), place=pa.array(place), node=pa.array(node))

    def meet(key, place, node, root, bits):
        # a bucket's members by node; copies from several tasks are one
        keep = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))[: len(key)]
        key, place, node, root, bits = key[keep], place[keep], node[keep], root[keep], bits[keep]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
        sizes = np.diff(np.append(starts, len(key)))
        if later:
            for at, size in zip(starts.tolist(), sizes.tolist(), strict=True):
                one = slice(at, at + size)
                pairs, left = _spanning_of(place[one], node[one], bits[one].tolist()) if spanning else _pairs_of(place[one], node[one], root[one], bits[one].tolist())
                for a, b in pairs:
                    yield out(len(a), a=pa.array(a), b=pa.array(b))
                if left.any():
                    yield over(key[one][left], place[one][left], node[one][left])
            return
        each = np.repeat(sizes, sizes)
        small, large = (each > 1) & (each <= SMALL), each > SMALL
        k, p, v = key[small], place[small], node[small]
        for s in range(1, int(each[small].max(initial=1))):
            near = k[s:] == k[:-s]
            near[near] = may_match(p[s:][near], p[:-s][near])
            if near.any():
                yield out(int(near.sum()), a=pa.array(v[s:][near]), b=pa.array(v[:-s][near]))
        if large.any():
            yield over(key[large], place[large], node[large])

    def run(batches):
        held: list[list[np.ndarray]] = []
        for b in batches:
            if not later:
                own = b.column(4).is_valid()
                if own.true_count:
                    part = b.filter(own)
                    yield out(part.num_rows, **dict(zip(names[2:], part.columns, strict=True)))
                    b = b.filter(b.column(4).is_null())
            new = [c.to_numpy(zero_copy_only=False) for c in b.columns[: 5 if later else 3]]
            if not len(new[0]):
                continue
            if not later:
                new += [new[2], new[2]]  # a node's root is itself; bitmaps come later
            held.append(new)
            if held[0][0][-1] == new[0][-1]:  # the last bucket goes on; what was held is one bucket
                if len(held) > 1:
                    continue
            key, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.searchsorted(key, key[-1]))
            yield from meet(key[:last], *(x[:last] for x in rest))
            held = [[key[last:], *(x[last:] for x in rest)]]
        if held:
            yield from meet(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = rows.repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, f"a long, b long, {CELL}")


def possible(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps don't rule them out. own: (node, place, bits)."""

    def run(batches):
        for b in batches:
            sizes = [(b.column(i).to_numpy(zero_copy_only=False) >> 32) for i in (2, 4)]
            apart = np.array([bits_apart(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True)], np.int64)
            near = pa.array(9 * apart <= sizes[0] + sizes[1])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], ["a", "b"])

    left = pairs.join(own.select(F.col("node").alias("a"), F.col("place").alias("m"), F.col("bits").alias("x")), "a")
    both = left.join(own.select(F.col("node").alias("b"), F.col("place").alias("n"), F.col("bits").alias("y")), "b")
    return both.select("a", "b", "m", "x", "n", "y").mapInArrow(run, "a long, b long")


def linked(own: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of sets that the generalised pigeonhole on their fingerprints gives. own: (node, fp).

    Sets of one fingerprint are paired with the least of them, which stands for them in links to other fingerprints.
    """
    least = checkpointed(own.groupBy("fp").agg(F.min("node").alias("least")))
    same = own.join(least, "fp").filter("node > least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    end = lambda fp, name: least.select(F.col("fp").alias(fp), F.col("least").alias(name))
    near = links(least, radius).toDF("x", "y").distinct().join(end("x", "p"), "x").join(end("y", "q"), "y")
    return same.union(near.select(F.least("p", "q"), F.greatest("p", "q"))).distinct()


def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that roots doesn't connect."""
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    placed = pairs.join(a, "a", "left").join(b, "b", "left")
    return placed.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _filter_words(named: DataFrame) -> np.ndarray:
    """Bit filter of the nodes, FILTER_BITS at most."""
    bit = F.pmod(F.col("node"), F.lit(FILTER_BITS))
    words = named.select(F.floor(bit / 64).cast("long").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("x")).groupBy("w").agg(F.bit_or("x").alias("x")).collect()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words:
        out[r["w"]] = r["x"]
    return out.view(np.uint64)


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the wanted nodes and a few others."""
    words = _filter_words(wanted)

    def run(batches):
        seen: set[int] = set()
        for _, sets in _texts(batches, 2):
            named = np.array([node_of(s) for s in sets], np.int64)
            bit = named % FILTER_BITS
            hit = np.flatnonzero(words[bit // 64] >> (bit % 64).astype(np.uint64) & np.uint64(1))
            hit = np.array([i for i in hit.tolist() if not (int(named[i]) in seen or seen.add(int(named[i])))], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(named[hit]), _lists([sets[i] for i in hit])], ["node", "hashes"])

    return rows.mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of 0.8 or more."""

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    size = lambda c: F.size(c).cast("long")
    # pair by pair in the JVM: batches of such rows would hold thousands of whole sets
    return both.filter(9 * size(F.array_intersect("x", "y")) >= 4 * (size("x") + size("y"))).select("a", "b")


def components(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root) of all nodes that are similar to another, and (doc_id, text_hash, node) of all rows."""
    met = checkpointed(_meet(cells(rows, common_shingles(rows.select("text")))))
    own = met.filter("text_hash is not null")
    known = own.select("node", "place", "bits", "fp").dropDuplicates(["node"])
    pairs = lambda met: met.filter("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    nodes = lambda pairs: pairs.select("a").union(pairs.select("b")).toDF("node").distinct()
    first = checkpointed(possible(linked(known.select("node", "fp")), known))
    near = checkpointed(possible(pairs(met), known))
    sets = checkpointed(_sets(rows, nodes(first.union(near))))
    roots = connected_components(similar(first, sets))
    near, spanning = checkpointed(between(near, roots)), True
    while True:
        if not (wanted := checkpointed(nodes(near).join(sets.select("node"), "node", "left_anti"))).isEmpty():
            sets = sets.union(checkpointed(_sets(rows, wanted)))
        found = checkpointed(similar(near, sets))
        # the components so far stand for the links that made them
        roots = connected_components(found.union(roots.toDF("a", "b")))
        rest = met.filter("a is null and text_hash is null").select("key", "place", "node")
        if rest.isEmpty():
            return roots, own.select("doc_id", "text_hash", "node")
        left = rest.join(known.select("node", "bits"), "node").join(roots, "node", "left")
        met = checkpointed(_meet(left.select("key", "place", "node", F.coalesce("root", "node").alias("root"), "bits"), spanning))
        near, spanning = checkpointed(pairs(met)), False


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group connected by similar texts: that of the least doc_id, ids that are null coming last.

    Null and blank texts are one group. Rows are decided by id and text, so ids may be null or repeat.
    """
    roots, by_row = components(_rows(docs, id_col, text_col))
    placed = by_row.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    kept = checkpointed(placed.groupBy("root").agg(first).select("first.doc_id", "first.text_hash"))
    id_, text_hash = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`"))
    keyed = docs.withColumns({"kept_id_": id_, "kept_hash_": text_hash})
    out = keyed.join(kept, keyed["kept_id_"].eqNullSafe(kept["doc_id"]) & (keyed["kept_hash_"] == kept["text_hash"]), "left_semi")
    if not by_row.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["kept_id_", "kept_hash_"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
