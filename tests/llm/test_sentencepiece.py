import hashlib

import numpy as np
import pytest
import sentencepiece as library
from pyspark.sql import functions as F

from tidelog.llm import sentencepiece as sp

ODD = [
    None, "", " ", "a ", " a  b   c", "\n\n x\r\n", "é ü 中文 😀", "<s> </s> <unk> <0x0A>", "\x00a\x01", " " * 41, "a" * 500, "x" * 9000 + " y", "12 345", "word " * 20000, "word " * 3, "word " * 3,
]


def test_parity_and_round_trip(spark):
    model = sp.read_model()
    peer = library.SentencePieceProcessor(model_proto=model)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    got = {r.row_.doc_id: r.ids for r in sp.encode_documents(docs, model).collect()}
    assert got == {i: peer.encode(t or "") for i, t in enumerate(ODD)}
    back = sp.encode_documents(docs, model).select("row_.doc_id", sp.decoded(F.col("ids"), model).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == {i: t or "" for i, t in enumerate(ODD)}
    for r in docs.select("doc_id", sp.verified(F.col("text"), model).alias("v")).collect():
        ids = got[r.doc_id]
        assert (r.v.n_tokens, r.v.round_trip, r.v.parity) == (len(ids), True, True)
        assert r.v.ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
    assert sp.encode_documents(docs.limit(0), model).count() == 0


def _field(n, value):
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    return varint(n << 3) + varint(value) if isinstance(value, int) else varint(n << 3 | 2) + varint(len(value)) + value


def _piece(text, score, kind):
    return _field(1, _field(1, text.encode()) + bytes([2 << 3 | 5]) + np.float32(score).tobytes() + _field(3, kind))


def test_unigram_model():
    """A small unigram model, written here in wire form, with byte fallback and squeezed white space."""
    pieces = [_piece("<unk>", 0, sp.UNKNOWN), _piece("<s>", 0, sp.CONTROL), _piece("</s>", 0, sp.CONTROL)]
    pieces += [_piece(f"<0x{i:02X}>", 0, sp.BYTE) for i in range(256)]
    pieces += [_piece(t, s, sp.NORMAL) for t, s in ((sp.MARK, -4), ("a", -3), ("b", -3.1), ("ab", -3.5), (sp.MARK + "a", -3.3), ("ba", -4.4), (sp.MARK + "ab", -5.2))]
    model = b"".join(pieces) + _field(2, _field(3, sp.UNIGRAM) + _field(35, 1) + _field(40, 0) + _field(41, 1) + _field(42, 2)) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 1) + _field(5, 1))
    peer, tok = library.SentencePieceProcessor(model_proto=model), sp.build(sp.parse(model))
    for text in ("", "ab", "aba  b", "  abab é ", "bbb a", "abaab 中"):
        assert tok.encode(text, add_special_tokens=False).ids == peer.encode(text)


def _small(kind, pieces, suffix=False, squeeze=False):
    head = [_piece("<unk>", 0, sp.UNKNOWN), _piece("<s>", 0, sp.CONTROL), _piece("</s>", 0, sp.CONTROL)]
    head += [_piece(f"<0x{i:02X}>", 0, sp.BYTE) for i in range(256)]
    trainer = _field(3, kind) + (_field(24, 1) if suffix else b"") + _field(35, 1) + _field(40, 0) + _field(41, 1) + _field(42, 2)
    return b"".join(head + [_piece(*p) for p in pieces]) + _field(2, trainer) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, int(squeeze)) + _field(5, 1))


PIECES = [(sp.MARK, -9.0, sp.NORMAL), ("a", -8.0, sp.NORMAL), ("b", -8.5, sp.NORMAL), ("ab", -1.0, sp.NORMAL), ("ba", -1.5, sp.NORMAL), ("aab", -2.5, sp.NORMAL)]
TEXTS = ["", "a", "ab", "aba  b", " abab é ", "aab [X] ab[X]ba", "a[X]b", "bbb a", "abaab 中", "[X][X]"]


@pytest.mark.parametrize("kind", [sp.BPE, sp.UNIGRAM])
@pytest.mark.parametrize("suffix", [False, True])
@pytest.mark.parametrize("user", [False, True])
def test_user_defined_pieces_and_suffix_markers(kind, suffix, user):
    ends = [("ab" + sp.MARK, -3.0, sp.NORMAL), ("b" + sp.MARK, -2.0, sp.NORMAL)] if suffix else [(sp.MARK + "ab", -3.0, sp.NORMAL), (sp.MARK + "b", -2.0, sp.NORMAL)]
    model = _small(kind, PIECES + ends + ([("[X]", 0.0, sp.USER)] if user else []), suffix)
    codec, peer = sp.Codec(model, 1, verify=True), library.SentencePieceProcessor(model_proto=model)
    parts = codec.parts(TEXTS)
    ids = codec.joined(parts)
    assert [np.frombuffer(x, "<i4").tolist() for x in ids] == peer.encode(TEXTS)
    assert all(codec.same(TEXTS, parts, ids))
    assert codec.decode(ids) == TEXTS


def test_parity_by_words_sees_a_wrong_word():
    codec = sp.Codec(sp.read_model(), 1, verify=True)
    assert codec.by_word
    codec.core = sp.build(sp.parse(_small(sp.BPE, PIECES)), bare=True)
    texts = ["the quick brown fox", ""]
    parts = codec.parts(texts)
    assert codec.same(texts, parts, codec.joined(parts)) == [False, True]


def test_words_have_the_ids_of_the_whole_text(spark, sf_dir):
    """What parity by words rests on, against the library on whole texts; with a cache that is emptied all the time, too."""
    model = sp.read_model()
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + [t or "" for t in ODD]
    codec, peer = sp.Codec(model, 2, verify=True), library.SentencePieceProcessor(model_proto=model)
    want = [np.array(x, "<i4").tobytes() for x in peer.encode(texts)]
    for at in range(0, len(texts), 64):
        codec.held = sp.CACHE_BYTES + 1
        parts = codec.parts(texts[at : at + 64])
        ids = codec.joined(parts)
        assert ids == want[at : at + 64] and all(codec.same(texts[at : at + 64], parts, ids))
    assert codec.decode(want) == [t.replace(sp.MARK, " ") for t in texts]


def test_unsupported_models_are_refused():
    with pytest.raises(ValueError):
        sp.parse(_piece("<unk>", 0, sp.UNKNOWN) + _field(2, _field(3, 3)))
