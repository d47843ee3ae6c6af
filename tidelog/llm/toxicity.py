"""Counterfactual-regularised toxicity classifier.

A logistic model over hashed features of a text's distinct words (whole words and word beginnings). Besides the log loss on
labelled documents, training penalises how far the score (in log odds) moves between two versions of a labelled sentence: as it
is and with its identity term swapped for another, or, where a document has none, with one and with another term put in. So the
model can't lean on the mention of a group, and neutral mentions aren't flagged.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Bound of the training sample, in labelled documents.
SAMPLE_ROWS = 12_000
#: What it takes for a feature to be kept: documents, chi-square and log odds.
LEAST_DOCS, LEAST_CHI2, LEAST_ODDS = 5, 25.0, 1.0
DIMS = 1 << 20
PENALTY, L2, ROUNDS = 4.0, 1e-6, 1500
SWAPS = 2
THRESHOLD = 0.3
SLICE = 256
#: Words whose features a worker remembers.
WORDS = 500_000

#: Terms that name groups of people, in the corpus's languages.
IDENTITY = (
    "woman women man men girl boy gay lesbian bisexual transgender straight black white asian african european american arab latino "
    "hispanic indigenous muslim muslims christian christians jew jewish jews hindu buddhist catholic protestant atheist immigrant "
    "immigrants refugee refugees foreigner disabled blind deaf autistic elderly young poor homeless "
    "frau frauen mann männer schwul lesbisch schwarze weiße muslime christen juden ausländer flüchtlinge behinderte "
    "femme femmes homme hommes homosexuel lesbienne noirs blancs musulman musulmans chrétien chrétiens juif juifs immigré réfugié handicapé "
    "mujer mujeres hombre hombres lesbiana negros blancos musulmán musulmanes cristiano cristianos judío judíos inmigrante refugiado discapacitado"
).split()

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[int]:
    names = [f"w {word}"] + [f"{n} {word[:n]}" for n in (4, 5) if len(word) > n]
    return [zlib.crc32(x.encode("utf-8", "replace")) % DIMS for x in names]


def ids_of(words: set[str]) -> np.ndarray:
    return np.array(sorted({f for w in words for f in features_of(w)}), np.uint32)


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_TERMS = frozenset(IDENTITY)


def counterfactuals(text: str | None, n: int = SWAPS) -> list[tuple[str, str]]:
    """n pairs of versions of the text's sentences that differ in an identity term only; the text decides which."""
    rng = random.Random(zlib.crc32((text or "").encode("utf-8", "replace")))
    sentences = [s for s in _SENTENCE.split((text or "").lower()) if s.strip()] or [""]
    held = [(s, m) for s in sentences for m in _WORD.finditer(s) if m[0] in _TERMS]
    out = []
    for _ in range(n):
        if held:
            s, m = rng.choice(held)
            out.append((s, s[: m.start()] + rng.choice([t for t in IDENTITY if t != m[0]]) + s[m.end() :]))
        else:
            ws = rng.choice(sentences).split()
            at = rng.randint(0, len(ws))
            a, b = rng.sample(IDENTITY, 2)
            out.append((" ".join([*ws[:at], a, *ws[at:]]), " ".join([*ws[:at], b, *ws[at:]])))
    return out


def held_out(id_col: Column) -> Column:
    return fold(id_col, 4) == 2


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[int, float]
    bias: float

    def scorer(self):
        """Scores one text; a text's features each count once."""
        seen: dict[str, tuple[int, ...]] = {}
        weights, bias = self.weights, self.bias

        def score(text: str | None) -> float:
            words = words_of(text)
            if len(seen) > WORDS:
                seen.clear()
            found: set[int] = set()
            for w in words:
                if (fs := seen.get(w)) is None:
                    fs = seen[w] = tuple(f for f in features_of(w) if f in weights)
                if fs:
                    found.update(fs)
            z = bias + sum(weights[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def train(docs: list[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], int]], penalty: float = PENALTY) -> ToxicityModel:
    """docs: (distinct feature ids, feature ids of both versions of some sentences, label). Without both labels the model is the prior."""
    y = np.array([t for _, _, t in docs], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return ToxicityModel({}, 6.0 if n1 else -6.0)
    row = np.repeat(np.arange(len(docs)), [len(f) for f, _, _ in docs])
    col = np.concatenate([f for f, _, _ in docs]).astype(np.int64)
    c1 = np.bincount(col, y[row], minlength=DIMS)
    c0 = np.bincount(col, 1 - y[row], minlength=DIMS)
    total = len(y)
    expect = (c1 + c0) * n1 / total
    chi2 = (c1 - expect) ** 2 * total * total / np.maximum(expect * n0 * (total - c1 - c0), 1e-9)
    odds = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
    fit = (c1 + c0 >= LEAST_DOCS) & (chi2 >= LEAST_CHI2) & (np.abs(odds) >= LEAST_ODDS)
    kept = np.flatnonzero(fit)
    terms = {t: np.array(features_of(t)) for t in IDENTITY}
    kept = np.unique(np.concatenate([kept, *terms.values()]))
    place = np.full(DIMS, -1)
    place[kept] = np.arange(len(kept))
    keep = place[col] >= 0
    row, col = row[keep], place[col[keep]]

    # Both versions of every counterfactual sentence, one with -1 and one with 1: what they share cancels out.
    pairs = [p for _, own, _ in docs for p in own]
    sign = [(k, f, s) for k, (a, b) in enumerate(pairs) for ids, s in ((a, -1.0), (b, 1.0)) for f in place[ids].tolist() if f >= 0]
    prow, pcol, pval = (np.array(x) for x in zip(*(sign or [(0, 0, 0.0)]), strict=True))

    size = len(kept)
    w, bias = np.zeros(size), float(np.log(n1 / n0))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, ROUNDS + 1):
        z = bias + np.bincount(row, w[col], minlength=total)
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / total
        slope = np.bincount(col, err[row], minlength=size) + L2 * w
        moved = np.bincount(prow, pval * w[pcol], minlength=len(pairs))
        slope += 2 * penalty / max(len(pairs), 1) * np.bincount(pcol, pval * moved[prow], minlength=size)
        g = np.append(slope, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return ToxicityModel({int(f): float(x) for f, x in zip(kept, w, strict=True) if abs(x) > 1e-6}, float(bias))


def fit(docs: DataFrame, labels: DataFrame, penalty: float = PENALTY) -> ToxicityModel:
    """Learns from labelled documents that aren't held out: SAMPLE_ROWS of them at most on average, picked by a hash of the id.

    Labels without an id or a mark are left out; of several marks of an id the greatest counts, and each of its rows is learned
    from. Without labels nothing is toxic.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    share = min(1.0, SAMPLE_ROWS / max(known.count(), 1))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < share * (1 << 20)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                texts = part.column(1).to_pylist()
                ids = [ids_of(words_of(t)).tobytes() for t in texts]
                swaps = [[ids_of(words_of(s)).tobytes() for pair in counterfactuals(t) for s in pair] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(swaps, pa.list_(pa.binary())), pa.array(ids, pa.binary())], ["toxic", "swaps", "ids"])

    # The sample's ids are broadcast: SAMPLE_ROWS bounds them.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.col("toxic").cast("int"), "text")
    got = rows.mapInArrow(run, "toxic int, swaps array<binary>, ids binary").collect()
    got.sort(key=lambda r: bytes(r["ids"]))  # whatever the order in which partitions came
    numbers = lambda x: np.frombuffer(bytes(x), np.uint32)
    return train([(numbers(r["ids"]), [(numbers(a), numbers(b)) for a, b in zip(r["swaps"][::2], r["swaps"][1::2], strict=True)], int(r["toxic"] > 0)) for r in got], penalty)


def scored(text: Column, model: ToxicityModel) -> Column:
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = model.scorer()
        for texts in batches:
            yield pa.array([score(t) for at in range(0, len(texts), SLICE) for t in texts.slice(at, SLICE).to_pylist()], pa.float64())

    return run.asNondeterministic()(text)


def classify(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts have the score of a text without features. Repeated rows are each scored; an empty table gives an empty
    result. Other columns are not read.
    """
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
