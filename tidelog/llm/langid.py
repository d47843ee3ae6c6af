"""Language ID by compression.

For each language a zstandard raw-content dictionary is made of sample text. A text is encoded with every dictionary, and the
language whose dictionary gives the fewest bytes wins; the score is 1 - least / second least, and narrow margins are rejected.
Texts with a margin under ``SECOND_LOOK`` (often very short, so that zstandard stores them as they are) are encoded once more
behind filler text of each language, counting only the bytes they add.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Bounds of the training sample: documents per language, characters read of each (from a place that a hash of the id picks), and
#: bytes of a dictionary, to which the documents give equal shares; what short ones leave goes to the longer ones.
SAMPLE_DOCS = 200
SAMPLE_CHARS = 2_000
DICT_BYTES = 65_536
FILLERS, FILLER_BYTES = 8, 700
#: Characters encoded at once: what a text says itself soon weighs more than the dictionary.
CHUNK = 3_000
SECOND_LOOK = 0.05
#: Documents with a smaller score are rejected.
MARGIN = 0.01
#: Texts that are Python objects at a time.
SLICE = 256

def plain(text: str) -> str:
    """Lower case, with single spaces."""
    return " ".join(text.lower().split())


@dataclass(frozen=True)
class LanguageModel:
    """Per language: dictionary content and fillers."""

    content: dict[str, tuple[bytes, tuple[bytes, ...]]]

    def encoders(self):
        import zstandard as zs

        out = {}
        for lang, (content, fillers) in sorted(self.content.items()):
            params = zs.ZstdCompressionParameters(
                window_log=17, chain_log=16, hash_log=16, search_log=4, min_match=3, target_length=32, strategy=zs.STRATEGY_GREEDY,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            kept = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(compression_params=params)
            encoder = zs.ZstdCompressor(dict_data=kept, compression_params=params)
            out[lang] = encoder.compress, fillers, sum(len(encoder.compress(f)) for f in fillers)
        return out

    @staticmethod
    def predict(encoders, text: str | None) -> tuple[str, float]:
        if not encoders or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0
        whole = " " + plain(text)
        chunks = [whole[i : i + CHUNK].encode("utf-8", "replace") for i in range(0, len(whole), CHUNK)]

        def best(sizes):
            order = sorted(sizes, key=lambda k: (sizes[k], k))
            if len(order) == 1:
                return order[0], 1.0
            return order[0], max(0.0, min(1.0, 1 - max(sizes[order[0]], 0) / max(sizes[order[1]], 1)))

        lang, score = best({k: sum(len(c(x)) for x in chunks) for k, (c, _, _) in encoders.items()})
        if score < SECOND_LOOK:
            lang, score = best({k: sum(len(c(f + b" " + x)) for x in chunks for f in fs) - alone * len(chunks) for k, (c, fs, alone) in encoders.items()})
        return lang, score


def shared(texts: list[bytes], total: int) -> list[bytes]:
    """The start of each text, total bytes with the spaces between them: equal shares, and what short texts leave goes to longer ones."""
    left, share = total, {}
    for k, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        share[i] = min(len(texts[i]), max(left // (len(texts) - k) - 1, 0))
        left -= share[i] + 1
    return [t[: share[i]] for i, t in enumerate(texts)]


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> LanguageModel:
    """Dictionaries from up to about SAMPLE_DOCS rows of each non-null language, picked by a hash of the id."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel({})
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * SAMPLE_DOCS / n) * 2**20))])
    spot = F.xxhash64(F.col(id_col), F.lit("sample"))
    sample = rows.filter(F.pmod(spot, F.lit(2**20)) < F.element_at(share, F.col(lang_col)))
    text = F.col(text_col)
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("place")), F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1).cast("int")
    sample = sample.select(F.col(lang_col).alias("lang"), spot.alias("spot"), F.substring(text, place + 1, F.lit(SAMPLE_CHARS)).alias("text")).collect()
    content = {}
    for lang in sorted(counts):
        texts = dict.fromkeys(plain(r["text"]) for r in sorted((r for r in sample if r["lang"] == lang), key=lambda r: (r["spot"], r["text"]))[:SAMPLE_DOCS])
        flat = b" ".join(shared([t.encode("utf-8", "replace") for t in texts], FILLERS * FILLER_BYTES + DICT_BYTES))
        if not flat.strip():
            continue
        held = min(FILLERS * FILLER_BYTES, len(flat) // 4)
        step = max(1, held // FILLERS)
        content[lang] = flat[held : held + DICT_BYTES], tuple(flat[i * step : (i + 1) * step] for i in range(FILLERS))
    return LanguageModel(content)


def predicted(text: Column, model: LanguageModel) -> Column:
    """struct<lang:string, score:double>."""

    @F.arrow_udf("lang string, score double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoders = model.encoders()
        for texts in batches:
            found = []
            for at in range(0, len(texts), SLICE):
                found += [model.predict(encoders, t) for t in texts.slice(at, SLICE).to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["lang", "score"])

    return run.asNondeterministic()(text)  # once a row, whatever stands above it


def held_out(id_col: Column) -> Column:
    return fold(id_col, 5) == 0


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected.

    Null texts and texts without a letter are ``und`` with score 0 and are rejected. Ties go to the first language by name. A
    table without any learnable row gives ``und`` throughout; an empty table gives an empty result. Repeated rows are each judged.
    """
    seen = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), predicted(F.col("text"), model).alias("p"))
    return seen.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), (F.col("p.score") < MARGIN).alias("rejected"))


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows of docs that are not rejected, with their columns as they are. Repeated rows are each judged; an empty table stays empty."""
    rows = docs.select(F.struct("*").alias("row_"), predicted(F.col("text"), model).alias("p_"))
    return rows.filter(F.col("p_.score") >= MARGIN).select("row_.*")


def learn(docs: DataFrame) -> LanguageModel:
    """From the documents that are not held out."""
    return fit(docs.filter(~held_out(F.col("doc_id"))))
