"""Boosted trees: array traversal against recursion, held-out accuracy, edge rows."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from gristmill.llm import op2_quality as op


def walk(trees, t, row):
    node, inner = 0, trees.feature.shape[1]
    while node < inner:
        node = 2 * node + (2 if row[trees.feature[t, node]] > trees.threshold[t, node] else 1)
    return trees.leaf[t, node - inner]


def test_traversal_equals_recursion():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] * x[:, 1] > 0)).astype(float)
    trees = op.fit_trees(x, y, trees=12, depth=3)
    raw = [trees.base + sum(walk(trees, t, r) for t in range(12)) for r in x]
    assert np.allclose(trees.predict(x), 1 / (1 + np.exp(-np.array(raw))))
    more = op.fit_trees(x, y, trees=80, depth=4)
    assert ((more.predict(x) > 0.5) == y).mean() > 0.9


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in op.query(spark, sf).collect()}
    labels = [r for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if got[r["doc_id"]].held_out]
    right = [got[r["doc_id"]].predicted == r["quality"] for r in labels]
    assert len(labels) > 50 and np.mean(right) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == pq.read_table(f"{sf}/documents.parquet").num_rows


SCHEMA = "doc_id long, text string, s string, y int, score double, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, ("word " * (5 + i % 7)) + ("### " * 9 if i % 2 else "."), "s", 1, 0.5, "en") for i in range(60)]
    return spark.createDataFrame([*rows, (60, None, None, None, None, None), (61, "", None, None, None, None), (None, "null id", None, None, None, None), (62, "long " * 200_000, None, None, None, None), rows[0]], SCHEMA)


def test_edges(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (5, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    kept = op.keep_good(docs, labels, threshold=0.5)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert {i for i in ids if i is not None and i < 60} == {i for i in range(60) if i % 2}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op.fit(docs, none) is None and op.keep_good(docs, none).count() == docs.count()
    trees = op.fit(docs, spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int"))
    scores = {round(r[0], 9) for r in docs.select(op.score(trees, "text")).collect()}
    assert len(scores) == 1 and scores.pop() > 0.9
    empty = docs.limit(0)
    assert op.keep_good(empty, labels).count() == 0
    repeated = [r.score for r in docs.where("doc_id = 0").select(op.score(trees, "text").alias("score")).collect()]
    assert len(repeated) == 2 and len(set(repeated)) == 1
