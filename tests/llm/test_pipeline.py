"""Each stage of the corpus pipeline against what its operator says of its input, and edge rows."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.errors import AnalysisException
from test_op3_mixing import size
from test_op7_simhash import slow_components, slow_fingerprint
from test_op8_rules import slow

import __spark_entry__
from gristmill.llm import op2_quality, op3_mixing, op8_rules, registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_classifier", "quality_rules", "near_dedup", "mixing", "encoding"]
    scores = {r.doc_id: r.predicted for r in op2_quality.query(spark, sf).collect()}
    one = stage["quality_classifier"](spark, docs, sf).cache()
    assert {r.doc_id for r in one.collect()} == {d for d, p in scores.items() if p} and one.columns == docs.columns
    two = stage["quality_rules"](spark, one, sf).cache()
    verdicts = op8_rules.verdicts(one, op8_rules.fit_rules(docs, labels))
    assert op8_rules.fit_rules(docs, labels)
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in verdicts.collect() if r.kept}
    assert all(not (s[0] < 10 or 100 * s[4] > 20 * s[0]) for s in (slow(r.text) for r in two.collect()))
    three = stage["near_dedup"](spark, two, sf).cache()
    rows = two.collect()
    groups = slow_components([r.doc_id for r in rows], [slow_fingerprint(r.text) for r in rows])
    assert sorted(r.doc_id for r in three.collect()) == sorted(set(groups.values()))
    four = stage["mixing"](spark, three, sf).cache()
    plan = {r.doc_id: r.taken for r in op3_mixing.mix_plan(three).collect()}
    words: Counter = Counter()
    for r in four.collect():
        words[r.doc_id] += size(r.text)
    assert dict(words) == {d: n for d, n in plan.items() if n} and four.columns == docs.columns
    five = stage["encoding"](spark, four, sf)
    want = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in four.collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in five.collect()) == want


def test_run_and_registration(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)) and registry.ORACLES.keys() <= names.keys()


def test_edges(spark, tmp_path):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    good = "this is a fine sentence of several different plain words, number {} and more"
    rows = [(i, good.format(i) if i % 2 else "| # | # " * 9 + str(i), "en", None if i % 3 else "a", None) for i in range(80)]
    rows += [(None, good, None, None, None), (200, None, None, None, None), (201, "", None, None, 0), (1, good.format(1), "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.doc_id is None or r.doc_id % 2 for r in out)
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    labels.limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).collect() == []


def test_very_long_texts_and_clashing_columns(spark, tmp_path):
    """Extra columns with the names of results stay through all stages but the last; long texts are mixed whole."""
    words = [f"w{i * i % 997}x{i}" for i in range(30_000)]
    rows = [(i, " ".join(words[i * 7 : i * 7 + 40]), "en", "a", 1, float(i), "f") for i in range(40)] + [(100, " ".join(words), "en", "a", 1, 0.5, "g")]
    docs = spark.createDataFrame(rows, SCHEMA + ", score double, fp string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns, name
    kept = {r.doc_id: r for r in now.collect()}
    assert kept[100].text == " ".join(words) and kept[100].score == 0.5 and kept[100].fp == "g"
    last = {r.doc_id: r for r in corpus_pipeline.encoding(spark, now, str(tmp_path)).collect()}
    assert last[100].decoded_sha256 == hashlib.sha256(" ".join(words).encode()).hexdigest()


def test_rules_without_documents_in_the_folder(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    with pytest.warns(UserWarning, match="no documents.parquet"):
        got = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    want = op8_rules.verdicts(docs, op8_rules.fit_rules(docs, labels))
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in want.collect() if r.kept} and got.columns == docs.columns
    (tmp_path / "documents.parquet").mkdir()
    with pytest.raises(AnalysisException):  # there, but without data: an error as before
        corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
