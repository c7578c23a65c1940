"""Token files: round trip, keyed access, recovery, edge rows."""

import zlib

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.llm import op5_token_files as op
from gristmill.llm._byte_level import Encoder
from gristmill.llm._common import parts

TEXTS = ["hello world", None, "", "  two  spaces \n\n", "<|endoftext|> is text", "日本語 text", "a" * 50_000, "x " * 30_000, "tab\there"]


@lru_cache
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op.default_tokenizer())
    t.encode_special_tokens = True
    return t


def direct(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, op.END_ID]


@pytest.fixture(scope="module")
def want():
    return [direct(t) for t in TEXTS]


def write(spark, tmp_path, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return op.write_token_files(df, f"file://{tmp_path}/tokens", **kw)


@pytest.mark.parametrize("shard_bytes", [32 << 20, 64])
def test_round_trip(spark, tmp_path, want, shard_bytes):
    rows = [(k * 7 - 20, t) for k, t in enumerate(TEXTS)]
    manifest = write(spark, tmp_path, rows[::-1], shard_bytes=shard_bytes, ranges=3)
    got = {r.doc_id: r for r in op.read_token_files(manifest).collect()}
    start = 0
    for (doc, _), ids in zip(rows, want, strict=True):
        r = got[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    files = op.TokenFiles(f"file://{tmp_path}/tokens")
    for (doc, _), ids in zip(rows, want, strict=True):
        assert files.get(doc).tolist() == ids
    assert files.get(10**15) is None and files.get(-(10**15)) is None
    for m in manifest.collect():
        shard = op.Shard(m.base)
        for doc in shard.keys().tolist():
            assert shard.get(doc).tolist() == want[[d for d, _ in rows].index(doc)]
        assert shard.get(10**15) is None


def test_many_shards_are_read_by_many_tasks_and_a_lookup_opens_one(spark, tmp_path, monkeypatch):
    manifest = write(spark, tmp_path, [(i, f"text {i}") for i in range(0, 400, 2)], shard_bytes=16, ranges=3)
    assert manifest.count() > 40
    read = op.read_token_files(manifest)
    used = read.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(used) > 12 and sum(r["count"] for r in used) == 200
    files, opened, init = op.TokenFiles(f"file://{tmp_path}/tokens"), [], op.Shard.__init__
    monkeypatch.setattr(op.Shard, "__init__", lambda self, base: (opened.append(base), init(self, base))[1])
    assert files.get(66).tolist() == direct("text 66") and len(opened) == 1
    assert files.get(67) is None and files.get(66) is not None and len(opened) <= 2


def test_rows_without_an_id_are_dealt_over_the_ranges(spark, tmp_path):
    rows = [(None, f"no id {i}") for i in range(300)] + [(1, "one")]
    manifest = write(spark, tmp_path, rows, ranges=4)
    assert manifest.count() >= 3 and sum(r.docs for r in manifest.collect()) == 301
    got = op.read_token_files(manifest).collect()
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(np.array(direct(t), "<u4").tobytes()) for _, t in rows)
    assert op.TokenFiles(f"file://{tmp_path}/tokens").get(1).tolist() == direct("one")


PIECES = ["it's 'tis ''s don't 'llama we'VE", "\u3000's", " \u3000 a", "a\u00a0b \u00a0c", "x'", "'", "'s", "\r\n\t", "１２ ½ ², Ⅷ", "e\u0301 \u0301", "😀😀 a😀", "\u0088F\u088f", "\U0002b73a\U000323b0", "\x00\x00 \x00"]


def test_pieces_are_the_matches_of_the_pattern():
    e = Encoder.load(op.default_tokenizer())
    assert e.mark is not None
    for texts in (TEXTS, PIECES):
        got = e.encode(pa.array(texts, pa.string()))
        assert [np.frombuffer(x, e.kind).tolist() for x in got] == [direct(t)[:-1] for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="ab'sTrevld .\n\t é1\u3000\u00a0", max_size=30)), max_size=5))
def test_any_text(texts):
    got = Encoder.load(op.default_tokenizer()).encode(pa.array(texts, pa.string()))
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [direct(t)[:-1] for t in texts]


def test_a_full_table_changes_nothing_and_slices_are_whole():
    e = Encoder(op.default_tokenizer(), kept=3)
    texts = pa.array([*TEXTS, *PIECES], pa.string())
    for _ in range(2):
        got = [x for p in parts(texts, texts, 20) for x in e.encode(p)]
        assert [np.frombuffer(x, e.kind).tolist() for x in got] == [direct(t)[:-1] for t in texts.to_pylist()]


def test_another_kind_of_tokenizer_encodes_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    e, t = Encoder(path), Tokenizer.from_file(path)
    assert e.mark is None
    got = e.encode(pa.array(["Hello  World", None, ""], pa.string()))
    assert np.frombuffer(got[0], e.kind).tolist() == t.encode("Hello  World", add_special_tokens=False).ids and got[1] == got[2] == b""


def test_query_columns(spark, sf_dir):
    import pyarrow.parquet as pq

    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    got = sorted(op.query(spark, sf_dir).collect())
    start = 0
    for r in got:
        ids = direct(docs[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_null_and_repeated_ids_and_empty(spark, tmp_path):
    rows = [(None, "no id"), (5, "five"), (5, "cinq"), (5, "five"), (1, "one")]
    got = sorted(op.read_token_files(write(spark, tmp_path, rows, ranges=2)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 5, 5, 5]
    assert sorted(r.ids_crc32 for r in got) == sorted(zlib.crc32(np.array(direct(t), "<u4").tobytes()) for _, t in rows)
    assert op.read_token_files(write(spark, tmp_path / "none", [])).collect() == []


def test_extra_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "one", "x", 3)], "doc_id long, text string, base string, start int")
    assert op.read_token_files(op.write_token_files(df, f"file://{tmp_path}/t")).count() == 1


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(-(1 << 62), 1 << 62), max_size=400))
def test_perfect_hash(keys):
    k = np.array(sorted(keys), np.int64)
    h = op.PerfectHash.build(k)
    assert sorted(h.slots(k).tolist()) == list(range(len(k)))
