"""SentencePiece by chunks, against the library on whole texts."""

import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

from papyra.llm.pieces import ChunkEncoder, decode_ids, encode_texts, piece_digests  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ENCODER = ChunkEncoder(MODEL)


def want(t):
    ids = SP.encode(t or "", add_eos=True)
    return " ".join(map(str, ids)).encode(), len(ids), SP.decode(ids).encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\tab<>/sé日\U0001f389\x00"), st.characters(exclude_categories=["Cs"]))), max_size=4))
def test_any_text(texts):
    assert list(ENCODER.encode(texts)) == [want(t) for t in texts]


def test_table_is_emptied(monkeypatch):
    monkeypatch.setattr("papyra.llm.pieces.TABLE_CHUNKS", 3)
    e = ChunkEncoder(MODEL)
    for t in ("a b c d e f", "x y z " * 50 + "y" * 500, "a b"):
        assert list(e.encode([t])) == [want(t)]
        assert len(e.table) <= 3


def test_rows(docs, rows):
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in piece_digests(docs, MODEL).collect()), key=str)
    h = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted(((d is None, d, want(t)[1], h(want(t)[0]), h(want(t)[2])) for d, t, _ in rows), key=str)


def test_idle_workers_keep_no_table(spark, docs):
    """A table that outlived its task was held by each of the pooled workers, beside those at work."""

    def held(batches):
        from papyra.llm import pieces

        for _ in batches:
            yield pa.record_batch([pa.array([sum(len(e.table) for e in pieces._encoders.values())])], names=["n"])

    piece_digests(docs.repartition(8), MODEL).collect()
    encode_texts(docs.repartition(8), MODEL).collect()
    # More tasks than workers: each of the pool gets some.
    assert {r["n"] for r in spark.range(0, 64, 1, 64).mapInArrow(held, "n long").collect()} == {0}


def test_round_trip(docs):
    back = decode_ids(encode_texts(docs.where("doc_id in (4, 6, 11)"), MODEL), MODEL)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in docs.where("doc_id in (4, 6, 11)").select("doc_id", "text").collect()}


def test_empty(nothing):
    assert piece_digests(nothing, MODEL).collect() == []
