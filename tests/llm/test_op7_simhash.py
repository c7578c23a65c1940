"""Fingerprints against a word-by-word version, links against all pairs, edge rows."""

import re

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import op7_simhash as op
from gristmill.llm._components import connected_components
from gristmill.llm._xxh64 import hash_slices

LOWER = {c: c + 32 for c in range(65, 91)}


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, prints, bits=2):
    up = {i: i for i in range(len(ids))}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    distinct = {}
    for i, p in enumerate(prints):
        up[root(i)] = root(distinct.setdefault(p, i))
    keys = list(distinct)
    arr = np.array(keys, np.uint64)
    for i, p in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(arr ^ np.uint64(p)) <= bits).tolist():
            up[root(distinct[p])] = root(distinct[keys[j]])
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, d in enumerate(ids)}


TEXTS = ["", None, " \t\n", "One", "one", "one two", "A b C d e f", "é ß ÀB cd", "x\x85y z w", "w " * 1000, "same words here " * 40, "a" * 600 + " b c", "日本 語 テスト です"]


def test_fingerprints():
    got = op.fingerprints([t.encode() if t is not None else None for t in TEXTS])
    assert got.tolist() == [slow_fingerprint(t) for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbZé \t\n\x0b中.", max_size=60), max_size=5))
def test_fingerprints_of_any_text(texts):
    assert op.fingerprints([t.encode() for t in texts]).tolist() == [slow_fingerprint(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=0, max_size=300), st.lists(st.tuples(st.integers(0, 300), st.integers(0, 120)), max_size=20))
def test_hashes(buf, cuts):
    start = np.array([min(a, len(buf)) for a, _ in cuts], np.int64)
    length = np.array([min(n, len(buf) - s) for (_, n), s in zip(cuts, start, strict=True)], np.int64)
    got = hash_slices(buf, start, length, longest=100)
    assert got.tolist() == [xxhash.xxh64_intdigest(buf[s : s + n], 42) for s, n in zip(start, length, strict=True)]


def near_codes(rng, n, centres=12):
    base = rng.integers(0, 1 << 63, centres, dtype=np.uint64) * np.uint64(2)
    flips = np.uint64(1) << rng.integers(0, 64, (n, 3)).astype(np.uint64)
    return base[rng.integers(0, centres, n)] ^ np.where(rng.random((n, 3)) < 0.6, flips, 0).astype(np.uint64)[:, 0] ^ np.where(rng.random((n, 3)) < 0.5, flips, 0).astype(np.uint64)[:, 1] ^ flips[:, 2]


def test_index_finds_all_pairs():
    rng = np.random.default_rng(3)
    codes = np.unique(near_codes(rng, 700))
    index = op.GrayIndex(codes, leaf=8, fan=4)
    got = {(int(a), int(b)) for q, m in index.search(codes, 2) for a, b in zip(q, m, strict=True)}
    want = {(i, int(j)) for i, c in enumerate(codes) for j in np.flatnonzero(np.bitwise_count(codes ^ c) <= 2)}
    assert got == want


@pytest.mark.parametrize("kw", [{}, {"leaf_rows": 40, "max_leaves": 64}, {"leaf_rows": 4, "max_leaves": 4096}])
def test_components(spark, kw):
    rng = np.random.default_rng(4)
    codes = near_codes(rng, 900)
    ids = rng.permutation(900).tolist()
    df = spark.createDataFrame(list(zip(ids, codes.view(np.int64).tolist(), strict=True)), "doc_id long, fp long")
    found = {r.fp: r.component_id for r in op.linked_fingerprints(df, **kw).collect()}
    want = slow_components(ids, codes.tolist())
    assert {d: found[int(c)] for d, c in zip(ids, codes.view(np.int64), strict=True)} == want


def test_driver_table(spark, sf_dir):
    rows = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    prints = [slow_fingerprint(r["text"]) for r in rows]
    want = slow_components([r["doc_id"] for r in rows], prints)
    got = op.query(spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {r["doc_id"]: f"{p:016x}" for r, p in zip(rows, prints, strict=True)}
    assert {r.doc_id: r.component_id for r in got} == want


def test_edges(spark):
    rows = [(5, None, "x"), (3, "", "x"), (9, " ", "x"), (4, "alpha beta gamma delta", "x"), (4, "alpha beta gamma delta", "x"), (2, "ALPHA beta gamma delta", "x"), (None, "alpha beta gamma delta", "x"), (7, "other text entirely " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id is not None, r.doc_id, r.component_id) for r in op.simhash_components(df).collect())
    assert got == [(False, None, None), (True, 2, 2), (True, 3, 3), (True, 4, 2), (True, 4, 2), (True, 5, 3), (True, 7, 7), (True, 9, 3)]
    kept = op.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id is not None, r.doc_id) for r in kept.collect()) == [(False, None), (True, 2), (True, 3), (True, 7)]
    assert op.simhash_components(df.limit(0)).count() == 0 and op.keep_one(df.limit(0)).count() == 0


def test_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


def test_unlinked_texts_of_one_id_stay(spark):
    a, b = "one plain sentence about rivers, boats and old stone bridges", "prices of seven copper kettles rose again while nobody was watching them"
    df = spark.createDataFrame([(1, a), (1, b), (1, b), (2, a), (3, b)], "doc_id long, text string")
    assert sorted(map(tuple, op.keep_one(df).collect())) == [(1, a), (1, b)]
