"""Encoding against the public library's own Unigram model of the same pieces, and exact round trips."""

import numpy as np
import pytest

from quire.llm import sentencepiece_codec as codec

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pieces():
    return codec.load()


@pytest.fixture(scope="module")
def library(pieces):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(codec.MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for i, p in enumerate(model.pieces):
        p.score = pieces.score[i] / codec.UNIT
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def run(pieces, texts):
    ids, ends = codec.encode(pieces, [t.encode() for t in texts])
    return [x.tolist() for x in np.split(ids, ends[:-1])]


TEXTS = ["", " ", "hello world", "  two  spaces ", "naïve café 日本語 🙂 x", "line\nbreak\ttab", "a" * 300, "x" * 47 + " " + "y" * 49, "Straße über", "\u0000\u0001", "한국어 텍스트", "é"]


def test_matches_the_library(pieces, library, documents):
    texts = TEXTS + [t[:3000] for t in documents]
    for text, ids in zip(texts, run(pieces, texts), strict=True):
        assert ids == library.encode(text), text[:80]


def test_round_trip(pieces, documents):
    texts = [t.encode() for t in [*TEXTS, "▁ marker ▁", *documents]]
    ids, ends = codec.encode(pieces, texts)
    assert codec.decode(pieces, ids, ends) == texts


def test_operator(spark, pieces):
    rows = spark.createDataFrame([(1, "hello", 5), (2, None, 6), (2, "", 7), (None, "hello", 8), (4, "z▁" * 40_000, 9)], "doc_id long, text string, pieces int")
    found = codec.encode_texts(rows).collect()
    assert sorted((r.doc_id or 0, r.n_pieces) for r in found)[:4] == sorted([(0, found[0].n_pieces), (1, found[0].n_pieces), (2, 0), (2, 0)])
    assert all(r.round_trip for r in found) and all(len(r.pieces) == r.n_pieces for r in found)
    again = {r.doc_id: r.text for r in codec.decode_pieces(codec.encode_texts(rows.where("doc_id is not null"))).collect()}
    assert again[1] == "hello" and again[4] == "z▁" * 40_000
    assert codec.encode_texts(rows.limit(0)).count() == 0


def test_lockstep_equals_single(pieces, documents):
    words = sorted({w.encode() for t in documents for w in t.split(" ") if 0 < len(w.encode()) < 47})[:2000]
    raw = [bytes([codec.MARK]) + w for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    lengths = np.array([len(r) for r in raw])
    which, s, e, piece = codec.solve(pieces, data, np.cumsum(lengths) - lengths, lengths)
    for i in range(0, len(raw), 17):
        one = codec.solve_one(pieces, raw[i])
        at = which == i
        assert [x.tolist() for x in (s[at], e[at], piece[at])] == [x.tolist() for x in one]
