"""Benchmark decontamination by latent semantic retrieval.

A document leaks an item if some WINDOW_SLACK-fold window of its words holds at least ``share`` of the item's words in order
(longest common subsequence); below ``verbatim`` the item's answer must be there too. The search:

1. Word frequencies by passage over all documents give IDF weights.
2. Any leak holds at least ``HITS`` of the item's rarest words (as many as leave too few others), so only the passages around
   such words are cut out; all others can't match.
3. A distributed randomised SVD of the TF-IDF passages and items gives a latent space, in which passages are searched by cosine.
4. Candidates are verified by longest common subsequence and by answer.

Benchmarks over BLOCK_CHARS are taken block by block, so what is sent to executors is bounded.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SHARE, VERBATIM, ANSWER_SHARE = 0.6, 0.8, 0.5
#: Items of fewer words must occur whole.
SHORT = 8
HITS = 3
WINDOW_SLACK, WINDOW_EXTRA = 1.5, 4
#: Words of a passage when document frequencies are counted.
PASSAGE = 64
RANK, OVERSAMPLE = 128, 10
COSINE = 0.2
BLOCK_CHARS = 20_000_000
SLICE = 256
#: Groups of tasks whose matrices are summed before the groups are.
FAN = 64
#: Rows of the word-by-rank matrix that are summed at once.
ROWS = 64

#: ASCII letters and digits, and whatever isn't ASCII, make words; all else separates them.
_SPACED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACED).split()


def answer_of(text: str) -> list[bytes]:
    """Words of the last sentence; of one-sentence items the last fifth."""
    sentences = [s for s in (words_of(x) for x in re.split(r"[.!?\n]+", text or "")) if s]
    if len(sentences) > 1:
        return sentences[-1]
    return sentences[0][-max(1, len(sentences[0]) // 5) :] if sentences else []


def needed(n: int, share: float = SHARE) -> int:
    return n if n < SHORT else math.ceil(share * n)


def window(n: int) -> int:
    return math.ceil(WINDOW_SLACK * n) + WINDOW_EXTRA


def bit_masks(seq) -> dict:
    masks: dict = {}
    for i, x in enumerate(seq):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def lcs(masks: dict, n: int, other) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    full = (1 << n) - 1
    v = full
    for x in other:
        if m := masks.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


@dataclass
class Items:
    """A block of benchmark items: ids, word ids and answers, by one vocabulary."""

    item_id: list
    words: list[np.ndarray]
    answers: list[list[int]]
    vocab: dict[bytes, int]

    @classmethod
    def of(cls, rows) -> Items:
        vocab: dict[bytes, int] = {}
        ids, words, answers = [], [], []
        for item_id, text in rows:
            if ws := words_of(text):
                ids.append(item_id)
                words.append(np.array([vocab.setdefault(w, len(vocab)) for w in ws], np.int32))
                answers.append([vocab[w] for w in answer_of(text)])
        return cls(ids, words, answers, vocab)


def _texts(batches, column=1) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            yield from zip(part.column(0).to_pylist(), part.column(column).to_pylist(), strict=True)


def passage_counts(docs: DataFrame, vocab: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many passages of all documents each word of the vocabulary is, and how many passages there are."""
    size = len(vocab)

    def run(batches):
        total, n, get = np.zeros(size, np.int64), 0, vocab.get
        for _, text in _texts(batches):
            ws = words_of(text)
            ids = np.fromiter(map(get, ws, repeat(-1)), np.int64, len(ws))
            at = np.flatnonzero(ids >= 0)
            n += -(-len(ws) // PASSAGE)
            total += np.bincount(np.unique(at // PASSAGE * size + ids[at]) % size, minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, size)), pa.array(np.append(total[some], n))], ["word", "n"])

    sums = {r["word"]: r["n"] for r in docs.select("doc_id", "text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return np.array([sums.get(i, 0) for i in range(size)], np.int64), sums.get(size, 0)


def anchors(items: Items, df: np.ndarray, share: float) -> tuple[list[np.ndarray], list[int]]:
    """Per item the words of its rarest positions, and how many positions of a leak must hold one of them."""
    out, least = [], []
    for ws in items.words:
        m = needed(len(ws), share)
        c = min(HITS, m)
        order = np.lexsort((ws, df[ws]))  # rarest first
        out.append(np.unique(ws[order[: len(ws) - m + c]]))
        least.append(c)
    return out, least


def passages(docs: DataFrame, items: Items, df: np.ndarray, share: float) -> DataFrame:
    """(doc_id, ids): the word ids, -1 for other words, around every place with enough of an item's words.

    Places with enough anchors are found first; of these, those stay where some window holds as many of the item's words in any
    order as a leak has in order.
    """
    rare, least = anchors(items, df, share)
    size = len(items.vocab)
    own = np.concatenate([np.zeros(0, np.int64), *rare])
    by_word = np.argsort(own, kind="stable")
    holder = np.repeat(np.arange(len(rare)), [len(r) for r in rare])[by_word]  # items of each anchor, word by word
    degree = np.bincount(own, minlength=size + 1)  # the last stands for -1
    first = np.cumsum(degree) - degree
    lengths = np.array([window(len(w)) for w in items.words])
    needs = np.array([needed(len(w), share) for w in items.words])
    least_ = np.array(least)
    vocab, words = items.vocab, items.words

    def cuts(ids: np.ndarray) -> set[tuple[int, int]]:
        at = np.flatnonzero(degree[ids])
        if len(at) == 0:
            return set()
        n = degree[ids[at]]
        pos = np.repeat(at, n)
        item = holder[np.repeat(first[ids[at]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.lexsort((pos, item))
        pos, item = pos[order], item[order]
        last = np.arange(len(item)) + least_[item] - 1
        ok = last < len(item)
        last = np.minimum(last, len(item) - 1)
        ok &= (item[last] == item) & (pos[last] - pos < lengths[item])
        found, before, marked = set(), (-1, -1), np.zeros(size + 1, bool)
        for i, p in zip(item[ok].tolist(), pos[ok].tolist(), strict=True):
            if before[0] != i or p > before[1]:
                s = int(lengths[i])
                if before[0] != i:  # places come item by item
                    if before[0] >= 0:
                        marked[words[before[0]]] = False
                    marked[words[i]] = True
                # Serves every window that starts up to half a window later, too.
                a, z = max(0, p - s), min(len(ids), p + s + s // 2)
                count = np.cumsum(marked[ids[a:z]])
                if count[-1] >= needs[i] and (z - a <= s or (count[s:] - count[:-s]).max() >= needs[i] or count[s - 1] >= needs[i]):
                    found.add((a, z))
                before = (i, p + s // 2)
        return found

    def run(batches):
        get = vocab.get
        for b in batches:
            docs_, rows = [], []
            for doc, text in _texts([b]):
                ws = words_of(text)
                ids = np.fromiter(map(get, ws, repeat(-1)), np.int32, len(ws))
                for a, z in sorted(cuts(ids)):
                    docs_.append(doc)
                    rows.append(ids[a:z])
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def _weighted(rows: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF rows of length 1, as (row, word, weight)."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    word = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    row, word = row[word >= 0], word[word >= 0]
    cell, tf = np.unique(row * len(idf) + word, return_counts=True)
    row, word = cell // len(idf), cell % len(idf)
    w = (1 + np.log(tf)) * idf[word]
    norm = np.sqrt(np.bincount(row, w * w, minlength=len(rows)))
    return row, word, w / np.maximum(norm[row], 1e-12)


def _summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by place; at is in ascending order."""
    out = np.zeros((n, rows.shape[1]))
    if len(at):
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out[at[starts]] = np.add.reduceat(rows, starts, axis=0)
    return out


def _times(sparse, dense: np.ndarray, n: int) -> np.ndarray:
    row, word, w = sparse
    return _summed(w[:, None] * dense[word], row, n)


def _batches_of_rows(batches) -> Iterator[tuple[list, list[np.ndarray]]]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            yield part.column(0).to_pylist(), [np.array(x, np.int64) for x in part.column(1).to_pylist()]


def _added(parts: DataFrame) -> DataFrame:
    """(block, data): the tasks' matrices summed by block, first in FAN groups of tasks, then those."""

    def add(t: pa.Table) -> pa.Table:
        total = 0
        for x in t.column("data"):
            total = total + np.frombuffer(x.as_buffer())
        return pa.table({"block": t.column("block")[:1], "data": pa.array([total.tobytes()], pa.binary())})

    kind = "block long, data binary"
    some = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN))).groupBy("block", "part").applyInArrow(add, kind)
    return some.groupBy("block").applyInArrow(add, kind)


def latent_space(cut: DataFrame, items: Items, idf: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Words by rank: the leading right singular vectors of all passages and items, by a randomised range finder.

    Two passes over the passages: Y = A'A Omega, summed block of rows by block; then the small matrix (AQ)'(AQ).
    """
    size = len(idf)
    wide = min(rank + OVERSAMPLE, size)
    omega = np.random.default_rng(seed).standard_normal((size, wide))

    def sketch(rows: list[np.ndarray]) -> np.ndarray:
        sparse = _weighted(rows, idf)
        y = _times(sparse, omega, len(rows))
        order = np.argsort(sparse[1], kind="stable")
        row, word, w = (x[order] for x in sparse)
        return _summed(w[:, None] * y[row], word, size)

    def sketches(batches):
        total = np.zeros((size, wide))
        for _, rows in _batches_of_rows(batches):
            total += sketch(rows)
        starts = range(0, size, ROWS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(starts))), pa.array([total[a : a + ROWS].tobytes() for a in starts], pa.binary())], ["block", "data"])

    parts = _added(cut.mapInArrow(sketches, "block long, data binary")).collect()
    own = sketch(items.words)
    for r in parts:
        own[r["block"] * ROWS : (r["block"] + 1) * ROWS] += np.frombuffer(r["data"]).reshape(-1, wide)
    q, _ = np.linalg.qr(own)

    def gram(rows: list[np.ndarray]) -> np.ndarray:
        b = _times(_weighted(rows, idf), q, len(rows))
        return b.T @ b

    def grams(batches):
        total = np.zeros((wide, wide))
        for _, rows in _batches_of_rows(batches):
            total += gram(rows)
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], ["block", "data"])

    small = gram(items.words)
    for r in _added(cut.mapInArrow(grams, "block long, data binary")).collect():
        small = small + np.frombuffer(r["data"]).reshape(wide, wide)
    values, vectors = np.linalg.eigh(small)
    return q @ vectors[:, np.argsort(values)[::-1][:rank]]


def _latent(rows: list[np.ndarray], idf: np.ndarray, space: np.ndarray) -> np.ndarray:
    x = _times(_weighted(rows, idf), space, len(rows))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def best_share(ids: list[int], masks: dict, n: int, m: int) -> tuple[int, int]:
    """Most words of the item in order within any window of the passage, and where that window starts; (0, 0) if under m."""
    size = window(n)
    if lcs(masks, n, ids) < m:
        return 0, 0
    starts = range(max(1, len(ids) - size + 1))
    best = (0, 0)
    for s in starts:
        if best[0] == n:
            break
        if s and ids[s - 1] not in masks and ids[min(s + size, len(ids)) - 1] not in masks:
            continue  # the same common words as one step before
        best = max(best, (lcs(masks, n, ids[s : s + size]), -s))
    return (best[0], -best[1]) if best[0] >= m else (0, 0)


def leaks_of(ids: list[int], words: list[int], masks: dict, answer: list[int], share: float, verbatim: float) -> tuple[float, str] | None:
    """(share of the item's words found in order, verbatim or paraphrase), or None."""
    n = len(words)
    m = needed(n, share)
    found, at = best_share(ids, masks, n, m)
    if not found:
        return None
    if found >= max(m, math.ceil(verbatim * n)):
        return found / n, "verbatim"
    part = ids[at : at + window(n)]
    if answer and lcs(bit_masks(answer), len(answer), part) >= ANSWER_SHARE * len(answer):
        return found / n, "paraphrase"
    return None


def _search(cut: DataFrame, items: Items, idf: np.ndarray, space: np.ndarray, share: float, verbatim: float, cosine: float) -> DataFrame:
    goal = _latent(items.words, idf, space)
    words = [w.tolist() for w in items.words]
    masks = [bit_masks(w) for w in words]
    answers, names = items.answers, items.item_id

    def run(batches):
        for docs_, rows in _batches_of_rows(batches):
            x = _latent(rows, idf, space) @ goal.T
            out = []
            for r, i in zip(*np.nonzero(x >= cosine), strict=True):
                if hit := leaks_of(rows[r].tolist(), words[i], masks[i], answers[i], share, verbatim):
                    out.append((docs_[r], names[i], hit[0], hit[1], float(x[r, i])))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "lcs_share", "kind", "cosine"])

    return cut.mapInArrow(run, "doc_id long, item_id long, lcs_share double, kind string, cosine double")


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, verbatim: float = VERBATIM, cosine: float = COSINE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per leaked (doc_id, item_id): lcs_share, kind and cosine of its best passage.

    Null, empty and wordless texts and items, and items without an item_id, leak nothing. Repeated rows give one result row. Rows with a null doc_id are
    reported under null. Other columns are not read; empty tables give an empty result.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / block_chars))
    found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, lcs_share double, kind string, cosine double")
    for k in range(blocks):
        block = Items.of(sorted(tuple(r) for r in items.filter((F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) & F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct().collect()))
        if not block.words:
            continue
        df, n = passage_counts(docs, block.vocab)
        idf = np.log((n + 1) / (df + 1)) + 1
        cut = checkpointed(passages(docs, block, df, share))
        found = found.union(_search(cut, block, idf, latent_space(cut, block, idf), share, verbatim, cosine))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs_share", "kind", "cosine")).alias("best"))
    return best.select("doc_id", "item_id", "best.lcs_share", "best.kind", "best.cosine")


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item. Rows without an id stay."""
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
