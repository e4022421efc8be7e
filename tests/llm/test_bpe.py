import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from grantrisk.llm import bpe
from grantrisk.llm.queries import op5_bpe

RANKS = bpe.read_ranks(bpe.RANKS)
WHOLE = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ALPHABET = st.sampled_from(list("ab1'st ré\n\t.,-_  \x1c漢☃\U0001f600"))


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=60), st.integers(1, 9))
def test_pieces_encode_like_the_whole(text, size):
    parts = list(bpe.pieces(text, size))
    assert "".join(parts) == text
    assert [i for p in parts for i in WHOLE.encode_ordinary(p)] == WHOLE.encode_ordinary(text)


def test_round_trip_of_odd_documents(odd_docs):
    coded = bpe.encode(odd_docs, bpe.RANKS)
    assert coded.columns == [*odd_docs.columns, "ids"]
    back = bpe.decode(coded, bpe.RANKS).collect()
    assert len(back) == odd_docs.count()
    for r in back:
        assert bytes(r.decoded) == (r.text or "").encode()
        assert list(r.ids) == WHOLE.encode_ordinary(r.text or "")


def test_ids_need_not_end_on_a_character(spark):
    ids = WHOLE.encode_ordinary("☃")
    assert len(ids) > 1
    got = bpe.decode(spark.createDataFrame([(ids[:1],), (None,), ([],)], "ids array<int>"), bpe.RANKS).collect()
    assert [bytes(r.decoded) for r in got] == ["☃".encode()[:len(got[0].decoded)], b"", b""]


def test_empty_table(no_docs):
    assert bpe.decode(bpe.encode(no_docs, bpe.RANKS), bpe.RANKS).count() == 0


def test_query_against_the_library(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(WHOLE.encode_ordinary(texts[r.doc_id]), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("a1. \n\t\xa0\x1c☃")), max_size=40), st.integers(1, 5))
def test_long_runs_encode_like_the_whole(text, longest):
    parts = list(bpe.long_runs(text, longest))
    assert "".join(p for p, _ in parts) == text
    got = [i for p, run in parts for i in (WHOLE._encode_single_piece(p) if run else WHOLE.encode_ordinary(p))]
    assert got == WHOLE.encode_ordinary(text)


def test_a_million_spaces(docs_of):
    texts = ["a" + space * 1_100_000 + end for space in " \n" for end in ("", "b c")] + ["plain words"]
    docs = docs_of(*[(i, t, "en", "a") for i, t in enumerate(texts)])
    for r in bpe.decode(bpe.encode(docs, bpe.RANKS), bpe.RANKS).collect():
        assert bytes(r.decoded).decode() == r.text
