"""Ids against tiktoken, round trips, edge rows."""

import base64
import hashlib
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import op9_bpe as op


@pytest.fixture(scope="module")
def reference():
    with open(op.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=op.default_pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return op.Codec.load(op.default_ranks(), op.default_pattern())


TEXTS = ["", None, " ", "hello world", "  two  spaces", "a\n\n b\t c ", "it's I'LL we've", "日本語のテキスト", "é" * 300, "x" * 5_000, "1234567 89", "<|endoftext|>", " nbsp 　wide  em", "a ́b", "emoji 😀😀 👍🏽", "\r\n\r\n", "word " * 3000, " lead", "trail ", "mixed  x  y"]


def test_known_texts(codec, reference):
    got = codec.encode(TEXTS)
    for t, ids in zip(TEXTS, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t or ""), t
        assert codec.decode(ids) == (t or "").encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text(codec, reference, texts):
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab'sT .\n\t é1", max_size=30), max_size=4))
def test_white_space(codec, reference, texts):
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)


@pytest.mark.parametrize("text", ["x" * 3_000, "abcdefghij" * 300, "日本語の" * 400, "é" * 2_000, "#!" * 1_500, "theinand" * 200 + " " + "ontion" * 300])
def test_long_pieces_are_linked_rows(codec, reference, text):
    assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["e", "t", "a", "in", "ing", "on", "the", "x", "xx"]), min_size=1, max_size=400))
def test_both_ways_to_merge_agree(codec, parts):
    piece = "".join(parts).encode()
    matrix = [b""]
    codec._merge_matrix([piece], np.array([len(piece)]), np.array([0]), matrix)
    assert codec._merge_linked(piece) == matrix[0]


def test_a_piece_of_a_million_letters(codec, reference):
    text = "".join(np.random.default_rng(4).choice(list("etaoinshrd"), 1_000_000))
    began = time.process_time()
    ids = codec.encode([text])[0]
    assert time.process_time() - began < 60 and np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)


def test_a_full_table_changes_nothing(reference):
    c = op.Codec.load(op.default_ranks(), op.default_pattern())
    small = op.Codec(c.ranks, op.default_pattern(), kept=3)
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in small.encode(TEXTS)] == [reference.encode_ordinary(t or "") for t in TEXTS]


def test_query(spark, sf_dir, reference):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    got = op.query(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = reference.encode_ordinary(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest())


def test_edges(spark, reference):
    df = spark.createDataFrame([(1, None, 5, "x"), (None, "no id", 5, "x"), (2, "", 5, "x"), (3, "same", 5, "x"), (3, "same", 5, "x")], "doc_id long, text string, n_tokens int, ids string")
    got = op.encode_decode(df).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(reference.encode_ordinary(t)) for t in ("", "no id", "", "same", "same"))
    assert op.encode_decode(df.limit(0)).count() == 0
    ids = {r.doc_id: r.ids for r in op.token_ids(df).collect()}
    assert ids[3] == reference.encode_ordinary("same") and ids[1] == []
