"""Text vectors of the registered size against a loop; term weights beyond the 200 most frequent."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import assert_same, connect
from conftest import DATA

from gristmill import lexicons
from gristmill.plans import registry


@pytest.fixture
def passages(tmp_path):
    pq.write_table(pq.read_table(DATA / "sf0.1" / "benchmark.parquet").slice(0, 60), tmp_path / "benchmark.parquet")
    return str(tmp_path)


def weighed(terms, least, most):
    tf = [Counter(t) for t in terms]
    df, every = Counter(t for c in tf for t in c), Counter(t for x in terms for t in x)
    known = sorted((t for t in df if df[t] >= least), key=lambda t: (-every[t], t))[:most]
    out = np.zeros((len(terms), len(known)))
    for row, c in zip(out, tf, strict=True):
        for k, t in enumerate(known):
            row[k] = (1 + math.log(c[t])) * (math.log((1 + len(terms)) / (1 + df[t])) + 1) if t in c else 0
        row /= np.linalg.norm(row) or 1
    return out


def test_registered_vectors_keep_all_terms_and_dimensions(spark, passages):
    drop = {*lexicons.TOPIC_STOP_WORDS, *lexicons.VECTOR_BRANDS}
    rows = sorted(pq.read_table(f"{passages}/benchmark.parquet").to_pylist(), key=lambda r: r["item_id"])
    words = [[w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", x) for x in (r["text"] or "").lower().split()) if len(w) >= 3 and w not in drop] for r in rows]
    grams = [[f" {w} "[i : i + k] for w in x for k in (2, 3, 4) for i in range(max(len(w) + 3 - k, 1))] for x in words]
    want = np.hstack([weighed([x + [f"{a} {b}" for a, b in zip(x, x[1:], strict=False)] for x in words], 3, 15_000), weighed(grams, 5, 5_000)])
    assert want.shape[1] > 500
    got = np.array([r.tfidf_embedding for r in registry.QUERIES["v19_v20_v21_text_vectors"](spark, passages).orderBy("item_id").collect()])
    assert got.shape == (60, np.linalg.matrix_rank(want)) and got.shape[1] > 50
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-9)


def test_term_weights_beyond_200_terms(spark):
    d = str(DATA / "sf0.1")
    name = "v19_f4_term_weights_15000"
    out = registry.QUERIES[name](spark, d)
    assert_same(out, connect(d), registry.ORACLES[name])
    assert out.agg({"i": "max"}).first()[0] >= 200
