"""SentencePiece models run by the tokenizers library.

The model file is parsed from its protobuf wire form, and its parts are rebuilt: the normaliser, the metaspace marker, the
unigram scores or BPE merges, and byte fallback. Batches are encoded on several threads. Where asked, the ids of every text are
held against those of the sentencepiece library, and decoding is held against the text.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Texts, and about as many characters, that are encoded at once.
SLICE, SLICE_CHARS = 256, 1_000_000
THREADS = 2
#: Bytes, by estimate, of the words and ids that a worker remembers.
CACHE_BYTES = 64 << 20
#: Words that are encoded as one text.
RUN = 512
#: A cut before each run of markers.
AT_MARKERS = f"{MARK}*[^{MARK}]+|{MARK}+"


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            n, i = (8, i) if key & 7 == 1 else (4, i) if key & 7 == 5 else _varint(b, i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


@dataclass(frozen=True)
class Model:
    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    unk_id: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool
    suffix: bool = False

    def user(self) -> list[str]:
        return [p for p, _, t in self.pieces if t == USER]


def parse(model: bytes) -> Model:
    pieces, trainer, normaliser = [], {}, {}
    for field, value in _fields(model):
        if field == 1:
            p = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
            pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0], p[3]))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normaliser = dict(_fields(value))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {kind} is neither unigram nor BPE")
    unk = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    return Model(tuple(pieces), kind, unk, bool(trainer.get(35, 0)), normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)), bool(trainer.get(24, 0)))


def merges(model: Model) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, in order of its score; equal scores by the place of the parts."""
    ids = {p: i for i, (p, _, t) in enumerate(model.pieces) if t == NORMAL}
    order = sorted((-model.pieces[i][1], i, p) for p, i in ids.items() if len(p) > 1)
    return [(p[:k], p[k:]) for _, _, p in order for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]


def word_pattern(model: Model) -> re.Pattern | None:
    """The finest of three cuts that no BPE piece of the model straddles: at letters' ends and markers, at markers, or none."""
    pieces = [p for p, _, t in model.pieces if t == NORMAL]
    straddle = lambda pattern: any(re.search(pattern, p) for p in pieces)
    if model.kind != BPE or straddle(f"{MARK}[^{MARK}]" if model.suffix else f"[^{MARK}]{MARK}"):
        return None
    if model.suffix:
        return re.compile(f"[^{MARK}]+{MARK}*|{MARK}+")
    if straddle(rf"[^\W\d_][\W\d_]|(?!{MARK})[\W\d_][^\W\d_]"):
        return re.compile(AT_MARKERS)
    return re.compile(rf"{MARK}*(?:[^\W\d_]+|(?:(?!{MARK})[\W\d_])+)|{MARK}+")


def build(model: Model, bare: bool = False):
    """A tokenizers.Tokenizer that gives the ids of the sentencepiece library. bare: for words that are normalised already."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    if model.kind == BPE:
        core = models.BPE(vocab, merges(model), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        low = min(s for _, s, t in model.pieces if t == NORMAL) - 10
        core = models.Unigram([(p, s if t == NORMAL else low) for p, s, t in model.pieces], model.unk_id, model.byte_fallback)
    out = Tokenizer(core)
    if bare:
        return out
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix:
        steps.append(normalizers.Replace(Regex("(?<=[\\s\\S])\\z"), MARK) if model.suffix else normalizers.Prepend(MARK))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence(back + ([decoders.Strip(" ", int(not model.suffix), int(model.suffix))] if model.dummy_prefix else []))
    return out


class Codec:
    """Encodes and decodes batches; ids are little-endian 32-bit numbers in bytes.

    Normalised texts are cut at user-defined pieces and where no piece can straddle the cut. The library encodes each batch's
    unseen words on several threads, and words are remembered with their ids up to CACHE_BYTES.
    """

    def __init__(self, model: bytes, threads: int = THREADS, verify: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        self.model, self.threads = parse(model), threads
        self.whole = build(self.model)
        self.words = word_pattern(self.model)
        self.core = build(self.model, bare=True)
        self.plain = not self.model.charsmap and not self.model.squeeze
        user = self.model.user()
        self.user = re.compile("(" + "|".join(map(re.escape, sorted(user, key=lambda p: (-len(p), p)))) + ")") if user else None
        self.seen: dict[str, bytes] = {}
        self.held = 0
        for i, (p, _, t) in enumerate(self.model.pieces):
            if t == USER:
                self.seen[p] = array("i", [i]).tobytes()
        self.fixed = dict(self.seen)
        self.bytes = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for p, _, t in self.model.pieces]
        #: Remembered words whose ids the sentencepiece library gives otherwise, if they are verified.
        self.odd: set[str] = set()
        self.peer = None
        if verify:
            import sentencepiece

            self.peer = sentencepiece.SentencePieceProcessor(model_proto=model)
        # Words that start with a marker, and don't end with one, can follow each other in a text; bytes tell where each ends.
        self.marked = self.words is not None and self.words.pattern == AT_MARKERS and self.plain and not self.user and self.model.dummy_prefix and self.model.escape and self.model.byte_fallback
        self.sizes = np.array([1 if t == BYTE else len(p.encode()) for p, _, t in self.model.pieces], np.int64)
        self.by_word = verify and self.marked

    def normalised(self, text: str) -> str:
        if not self.plain:
            return self.whole.normalizer.normalize_str(text)
        if text and self.model.dummy_prefix:
            text = text + MARK if self.model.suffix else MARK + text
        return text.replace(" ", MARK) if self.model.escape else text

    def clean(self, text: str) -> str:
        """What decoding must give back."""
        out = self.normalised(text).replace(MARK, " ")
        if self.model.dummy_prefix:
            return out.removesuffix(" ") if self.model.suffix else out.removeprefix(" ")
        return out

    def cut(self, text: str) -> list[str]:
        if self.user is None:
            return self.words.findall(text) if self.words else [text]
        parts = self.user.split(text)
        out = []
        for i, part in enumerate(parts):
            out += [part] if i % 2 else self.words.findall(part) if self.words else [part] * bool(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.joined(self.parts(texts))

    def parts(self, texts: list[str]) -> list[list[str]]:
        """The words of each text; the ids of all are remembered afterwards."""
        cut = [self.cut(self.normalised(t)) for t in texts]
        if self.held > CACHE_BYTES:
            self.seen, self.held = dict(self.fixed), 0
            self.odd.clear()
        self.learn([w for w in set().union(*cut) if w not in self.seen])
        return cut

    def learn(self, words: list[str]) -> None:
        """Words that go together are encoded as one text, whose pieces are dealt out to them by length."""
        alone = words
        if self.marked:
            alone = [w for w in words if w[-1] == MARK]
            rest = [w for w in words if w[-1] != MARK]
            runs = [rest[at : at + RUN] for at in range(0, len(rest), RUN)]
            texts = ["".join(run) for run in runs]
            ids = [np.array(e.ids, "<i4") for e in self.core.encode_batch_fast(texts, add_special_tokens=False)]
            theirs = self.peer.encode([t[1:].replace(MARK, " ") for t in texts], num_threads=self.threads) if self.by_word else [None] * len(texts)
            if runs:
                flat = np.concatenate(ids)
                ends = np.cumsum([len(w.encode()) for w in rest])
                cuts = (4 * np.searchsorted(np.cumsum(self.sizes[flat]), ends) + 4).tolist()
                data = flat.tobytes()
                self._keep(rest, [data[a:z] for a, z in zip([0, *cuts], cuts, strict=False)])
            for run, x, y in zip(runs, ids, theirs, strict=True):
                if y is not None and x.tobytes() != array("i", y).tobytes():
                    alone += run  # one by one, to see which
        for at in range(0, len(alone), 8192):
            some = alone[at : at + 8192]
            ids = [np.array(e.ids, "<i4").tobytes() for e in self.core.encode_batch_fast(some, add_special_tokens=False)]
            self._keep(some, ids)
            if self.by_word:
                bare = [w[1:].replace(MARK, " ") for w in some]
                theirs = [np.array(y, "<i4").tobytes() for y in self.peer.encode(bare, num_threads=self.threads)]
                # of a marker alone nothing is left to encode
                self.odd.update(w for w, t, x, y in zip(some, bare, ids, theirs, strict=True) if x != (y if t else np.array([self.peer.piece_to_id(MARK)], "<i4").tobytes()))

    def _keep(self, words: list[str], ids: list[bytes]) -> None:
        self.seen.update(zip(words, ids, strict=True))
        self.held += 240 * len(words) + 2 * sum(map(len, words)) + sum(map(len, ids))

    def joined(self, parts: list[list[str]]) -> list[bytes]:
        get = self.seen.__getitem__
        return [b"".join(map(get, words)) for words in parts]

    def same(self, texts: list[str], parts: list[list[str]], ids: list[bytes]) -> list[bool]:
        """Whether the sentencepiece library gives the same ids.

        Where every word starts with the marker, and no piece straddles two words, the library's ids of a text are those of its
        words one after another; so each distinct word is held against the library. Other models: each whole text.
        """
        if self.by_word:
            return [not self.odd or self.odd.isdisjoint(words) for words in parts]
        return [array("i", x).tobytes() == y for x, y in zip(self.peer.encode(texts, num_threads=self.threads), ids, strict=True)]

    def decode(self, ids: list[bytes]) -> list[str]:
        out = []
        for x in ids:
            numbers = np.frombuffer(x, "<i4").tolist()
            try:
                text = b"".join(map(self.bytes.__getitem__, numbers)).decode()
                if self.model.dummy_prefix:
                    text = text.removesuffix(" ") if self.model.suffix else text.removeprefix(" ")
                out.append(text)
            except (UnicodeDecodeError, IndexError):  # bytes that aren't text, or ids out of range
                out.append(self.whole.decode(numbers, skip_special_tokens=False))
        return out


def _sliced(texts: pa.Array) -> Iterator[list[str]]:
    """Few texts as Python objects at a time. A null counts as empty."""
    for at in range(0, len(texts), SLICE):
        batch, size = [], 0
        for t in texts.slice(at, SLICE).to_pylist():
            batch.append(t or "")
            size += len(t or "")
            if size >= SLICE_CHARS:
                yield batch
                batch, size = [], 0
        if batch:
            yield batch


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encoded(text: Column, model: bytes, threads: int = THREADS) -> Column:
    """array<int> of the ids. Null and empty texts give an empty array. Ids leave the worker slice by slice."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(model, threads)
        for texts in batches:
            if not len(texts):
                yield _lists([])
            for batch in _sliced(texts):
                yield _lists(codec.encode(batch))

    return run.asNondeterministic()(text)


def decoded(ids: Column, model: bytes, threads: int = THREADS) -> Column:
    """Text of an array of ids; null gives empty text. Repeated rows are each decoded; an empty table gives an empty result."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(model, threads)
        for b in batches:
            for at in range(0, max(len(b), 1), SLICE):
                yield pa.array(codec.decode([array("i", x or []).tobytes() for x in b.slice(at, SLICE).to_pylist()]), pa.string())

    return run.asNondeterministic()(ids)


def verified(text: Column, model: bytes, threads: int = THREADS) -> Column:
    """struct<n_tokens, ids_sha256, round_trip, parity> of each text, encoded and decoded whole.

    ids_sha256 is of the ids as little-endian 32-bit numbers; round_trip: the ids decode to the normalised text; parity: the
    sentencepiece library gives the same ids (see Codec.same). Null counts as empty: no tokens. Repeated rows each have a value;
    an empty table gives an empty result.
    """

    @F.arrow_udf("n_tokens long, ids_sha256 string, round_trip boolean, parity boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(model, threads, verify=True)
        names = ["n_tokens", "ids_sha256", "round_trip", "parity"]
        kinds = (pa.int64(), pa.string(), pa.bool_(), pa.bool_())
        for texts in batches:
            if not len(texts):
                yield pa.StructArray.from_arrays([pa.array([], k) for k in kinds], names)
            for batch in _sliced(texts):
                parts = codec.parts(batch)
                ids = codec.joined(parts)
                want = map(codec.clean, batch)
                cols = (
                    [len(x) // 4 for x in ids],
                    [hashlib.sha256(x).hexdigest() for x in ids],
                    [a == b for a, b in zip(codec.decode(ids), want, strict=True)],
                    codec.same(batch, parts, ids),
                )
                yield pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names)

    return run.asNondeterministic()(text)


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """All columns of docs in one struct ``row_``, with ids. An empty table gives an empty result; repeated rows are each encoded."""
    return docs.select(F.struct("*").alias("row_"), encoded(F.col(f"`{text_col}`"), model).alias("ids"))
