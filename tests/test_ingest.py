"""Ingest, sinks, runs and the pipeline over small tables."""

import json

import pytest
from pyspark.sql import functions as F

from gristmill import schemas
from gristmill.operators import health, ingest, quality
from gristmill.plans import pipeline, registry
from gristmill.sources import tables
from gristmill.streaming import ingest as stream

RAW = "app_id string, reviewId string, score int, content string, at string, reviewCreatedVersion string, thumbsUpCount int, replyContent string, seq long"


def raw(spark, rows):
    return spark.createDataFrame([(a, i, s, c, "2024-01-01 00:00:00", None, None, "", k) for k, (a, i, s, c) in enumerate(rows)], RAW)


BATCH = [("a", "1", 5, "first"), ("a", "1", 4, "second"), ("a", "2", 0, "no score"), ("a", "3", 3, ""), ("b", "1", 5, "other app"), ("b", "9", None, "none"), ("c", "7", 5, "unknown app"), ("b", "8", 2, "ok")]


def test_new_reviews(spark):
    apps = spark.createDataFrame([("a",), ("b",)], "app_id string")
    known = spark.createDataFrame([("b", "8x"), ("b", "3y")], "app_id string, review_id string")
    batch = ingest.coerce(raw(spark, BATCH), "en", "us", "2024-01-02 00:00:00")
    got = {r.review_id: r for r in ingest.new_reviews(batch, known, apps).collect()}
    assert set(got) == {"1", "3", "8"} and got["1"].text == "first" and got["1"].app_id == "a" and got["3"].text is None and got["8"].thumbs_up == 0 and got["8"].reply is None
    stored = ingest.new_reviews(batch, known, apps).select("app_id", "review_id").unionByName(known)
    assert ingest.new_reviews(batch, stored, apps).count() == 0
    counts = {r.app_id: (r.fetched, r.attempted, r.stored, r.skipped) for r in ingest.ingest_counts(batch, known, apps).collect()}
    assert counts["a"] == (4, 3, 2, 1) and counts["b"] == (3, 3, 1, 0) and counts["c"] == (1, 1, 0, 0)
    runs = {r.app_id: r.status for r in ingest.finished_runs(spark.createDataFrame([("a",), ("z",)], "app_id string"), ingest.ingest_counts(batch, known), "2024-01-01", "2024-01-02").collect()}
    assert runs == {"a": "success", "z": "failed"}


def test_upserts(spark):
    stored = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, extra string")
    rows = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, ingest.upsert_replace(stored, rows, "k").collect())) == [(1, "a", "x"), (2, "B", None), (3, "C", None)]
    assert sorted(map(tuple, ingest.upsert_ignore(stored.drop("extra"), rows, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "C")]
    assert sorted(map(tuple, ingest.update_by_key(stored, rows, "k").collect())) == [(1, "a", "x"), (2, "B", "y")]
    again = spark.createDataFrame([(2, "B", 2), (2, None, 3), (2, "first", 1), (3, "C", 5), (3, "D", 4), (3, "E", 6)], "k int, v string, seq int")
    assert sorted(map(tuple, ingest.upsert_replace(stored, again, "k", "seq").collect())) == [(1, "a", "x"), (2, None, None), (3, "E", None)]
    assert sorted(map(tuple, ingest.upsert_ignore(stored.drop("extra"), again, ["k"], "seq").collect())) == [(1, "a"), (2, "b"), (3, "D")]
    assert sorted(map(tuple, ingest.update_by_key(stored, again, "k", "seq").collect())) == [(1, "a", "x"), (2, None, "y")]
    assert sorted(map(tuple, ingest.update_by_key(stored.drop("extra"), again.withColumnRenamed("v", "w"), "k", "seq").collect())) == [(1, "a", None), (2, "b", None)]
    ids = ingest.with_ids(stored.union(stored), ["v"], start=10, ranges=3).select("id").collect()
    assert sorted(r.id for r in ids) == [11, 12, 13, 14]


def test_duplicates_keep_their_definitions(spark):
    rows = [("a", "t"), ("a", "t"), ("a", "t"), ("b", "t"), ("a", None), ("a", None), ("b", "T")]
    df = spark.createDataFrame(rows, "app_id string, text string")
    r = health.duplicate_report(df).first()
    assert (r.n_groups, r.n_members, r.n_extras) == (1, 3, 3)
    assert quality.duplicate_members(df, ("app_id", "text")).count() == 5


def test_weak_labels(spark):
    rows = [(1, "a", "Great App!!"), (2, "a", "great app!!"), (3, "a", "great app!!"), (4, "b", "Great App!!"), (5, "b", "great app!!"), (6, "c", "😀" * 10), (7, "c", "abcdefghi"), (8, "c", "abcdefghij"), (9, "c", None), (10, "c", "12345678901")]
    got = {r.i: r.low_quality_label for r in quality.weak_labels(spark.createDataFrame(rows, "i int, app_name string, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1, 7: 1, 8: 0, 9: 1, 10: 1}


def test_quality_model(spark):
    rows = [(i, "a", ("bad text " * (1 + i % 3)) if i % 4 else f"a decent long remark, number {i}. It says why!", i % 5, int(bool(i % 4))) for i in range(80)]
    df = quality.with_features(spark.createDataFrame(rows, "review_id int, app_name string, text string, thumbs_up int, low_quality_label int"))
    moments, model = quality.train(df)
    scored = quality.predict(df, moments, model)
    assert quality.confusion(scored, "low_quality_label", "low_quality_pred").first().f1 > 0.95
    assert len(quality.importance(model)) == 8
    sample = quality.validation_sample(scored, 10).collect()
    assert len(sample) == 10 and sum(r.low_quality_pred for r in sample) == 5
    assert min(quality.cross_validate(df, 2)) > 0.9


def test_first_runs_tie(spark):
    runs = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", 6), (4, "b", 7)], "id int, app_id string, started_at int")
    assert {r.id for r in health.with_first_run(runs).where("is_first").collect()} == {1, 2, 4}


def test_csv_models_and_reports(spark, tmp_path):
    rows = [("a", 'said "no", then\nleft', 1.5), ("b", None, None)]
    df = spark.createDataFrame(rows, "k string, t string, x double")
    tables.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "csv"), df.schema).collect())) == sorted(rows)
    tables.write_text(spark, "hello\n", f"file://{tmp_path}/report.txt")
    assert (tmp_path / "report.txt").read_text() == "hello\n"
    assert tables.scan_optional(spark, str(tmp_path), "runs", schemas.RUNS).count() == 0
    v = tables.vector_preview(spark.createDataFrame([(1, [0.5] * 7), (2, None)], "i int, e array<double>"), ["e"]).orderBy("i").collect()
    assert v[0].e == "0.5000, 0.5000, 0.5000, 0.5000, 0.5000..." and v[1].e is None


def _source_records(app_id, count, lang, country):
    return [{"reviewId": f"{app_id}{i}", "score": 5, "content": f"{lang} text {i}"} for i in range(min(count, 3))]


def test_review_source(spark, tmp_path, monkeypatch):
    import sys

    from gristmill.sources.review_source import ReviewSource

    (tmp_path / "fake_client.py").write_text("def fetch(app_id, count, lang, country):\n    return [{'reviewId': f'{app_id}{i}', 'score': 5, 'content': lang} for i in range(min(count, 3))]\n")
    monkeypatch.setattr(sys, "path", [str(tmp_path), *sys.path])
    spark.sparkContext.addPyFile(str(tmp_path / "fake_client.py"))
    spark.dataSource.register(ReviewSource)
    df = spark.read.format("reviews").option("client", "fake_client:fetch").option("apps", "a, b").option("count", "2").load()
    assert sorted((r.app_id, r.reviewId, r.seq) for r in df.collect()) == [("a", "a0", 0), ("a", "a1", 1), ("b", "b0", 0), ("b", "b1", 1)]


def _apps(spark, root):
    rows = spark.createDataFrame([("a", "App A", "x", None), ("b", "App B", "x", None)], schemas.APPS)
    rows.write.parquet(f"{root}/apps.parquet")


def test_a_failed_ingest_leaves_failed_runs(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    _apps(spark, root)
    batch = raw(spark, [("a", f"r{i}", 1 + i % 5, "some text that is long enough") for i in range(6)])
    write, calls = tables.append_table, []

    def fail_once(df, where, name):
        calls.append(name)
        if calls.count("reviews") == 1 and name == "reviews":
            raise OSError("disk")
        write(df, where, name)

    monkeypatch.setattr(tables, "append_table", fail_once)
    pipeline.retried(pipeline.ingest_stage, spark, root, batch, "2024-01-01 00:00:00", "2024-01-01 01:00:00", retries=1, pause_s=0)
    runs = tables.scan(spark, root, "ingestion_runs").where("app_id = 'a'").orderBy("id").collect()
    assert [(r.status, r.reviews_collected) for r in runs] == [("failed", 0), ("success", 6)]
    reviews = tables.scan(spark, root, "reviews")
    assert reviews.count() == 6 and {r.ingestion_run_id for r in reviews.collect()} == {runs[1].id}


def test_short_text_alert_is_about_20_characters(spark):
    texts = ["x" * 15] * 4 + ["x" * 30] * 6
    r = health.short_texts(spark.createDataFrame([(t,) for t in texts], "text string")).first()
    assert (r.n_under_10, r.n_under_20, r.alert) == (0, 4, True)


def test_daily_pipeline_is_idempotent(spark, tmp_path):
    root = str(tmp_path)
    _apps(spark, root)
    texts = ["The update made login slow and the app crash", "great app great search, love it", "hm", ""]
    batch = raw(spark, [("a", f"r{i}", 1 + i % 5, texts[i % 4]) for i in range(20)])
    for _ in range(2):
        report = pipeline.daily(spark, root, batch, "2024-01-01 00:00:00", "2024-01-01 01:00:00", retries=0).collect()
    reviews, features, runs = (tables.scan(spark, root, n) for n in ("reviews", "features", "ingestion_runs"))
    assert reviews.count() == 20 and features.count() == 10 and runs.count() == 4
    assert sorted(r.id for r in reviews.select("id").collect()) == list(range(1, 21)) and runs.where("app_id = 'b'").first().status == "failed"
    assert any(r.section == "verdict" for r in report) and health.text_report(report)
    backlog = pipeline.backlog_of(features, reviews, "2024-01-10", least=1).collect()
    assert {r.aspect for r in backlog} >= {"login", "crash"} and [r.rank for r in sorted(backlog, key=lambda r: r.rank)] == list(range(1, len(backlog) + 1))


def test_retries():
    calls = []

    def stage():
        calls.append(1)
        if len(calls) < 2:
            raise ValueError
        return "ok"

    assert pipeline.retried(stage, pause_s=0) == "ok"
    with pytest.raises(ZeroDivisionError):
        pipeline.retried(lambda: 1 / 0, pause_s=0)


def test_stream_ingest(spark, tmp_path):
    root, inbox = str(tmp_path / "root"), tmp_path / "in"
    inbox.mkdir()
    record = lambda a, i, s: json.dumps({"app_id": a, "reviewId": i, "score": s, "content": "text", "at": "2024-01-01 00:00:00"})
    (inbox / "1.json").write_text("\n".join([record("a", "1", 5), record("a", "2", 0), record("a", "1", 3)]))
    run = lambda: stream.start(stream.raw_stream(spark, str(inbox)), root, str(tmp_path / "cp")).awaitTermination()
    run()
    (inbox / "2.json").write_text("\n".join([record("a", "1", 5), record("b", "3", 4)]))
    run()
    got = spark.read.parquet(f"{root}/reviews.parquet").orderBy("review_id").collect()
    assert [(r.review_id, r.rating) for r in got] == [("1", 5), ("3", 4)]


def test_stream_trend(spark, tmp_path):
    path = str(tmp_path / "labels")
    rows = [("1", "2024-01-02", "negative"), ("1", "2024-01-02", "negative"), ("2", "2024-01-03", "positive"), ("3", "2024-03-03", "positive")]
    spark.createDataFrame(rows, "review_id string, d string, combined_label string").select("review_id", F.to_timestamp("d").alias("date"), "combined_label").write.parquet(path)
    df = spark.readStream.schema("review_id string, date timestamp, combined_label string").parquet(path)
    q = stream.label_trend(df).writeStream.format("memory").queryName("trend").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.combined_label, r.n) for r in spark.table("trend").collect()) == [("negative", 1), ("positive", 1), ("positive", 1)]


def _exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]


def test_weak_labels_do_not_shuffle_texts(spark):
    rows = [(1, "a", "Great App!!"), (2, "a", "Great App!!"), (3, "a", " great app!!\n"), (4, None, "Great App!!"), (5, None, "Great App!!"), (6, "a", None), (7, "a", None)]
    df = quality.weak_labels(spark.createDataFrame(rows, "i int, app_name string, text string")).select("i", "low_quality_label")
    assert _exchanges(df) and not any("text#" in x or "folded#" in x.replace("__folded#", "") for x in _exchanges(df))
    assert {r.i: r.low_quality_label for r in df.collect()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1, 7: 1}


def _texts_read_by(spark, sf_dir, folder, name):
    """What the plan of a query still reads of documents when it comes back, where there is a folder of checkpoints."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"file://{folder}")
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.count() > 0
    return [f for f in df.inputFiles() if "documents.parquet" in f]


def test_quality_scores_read_texts_once(spark, sf_dir, tmp_path):
    assert _texts_read_by(spark, sf_dir, tmp_path, "v15_v18_t8_quality_scores") == []


def test_validation_sample_reads_texts_once(spark, sf_dir, tmp_path):
    assert _texts_read_by(spark, sf_dir, tmp_path, "t7_u1_validation_sample") == []
