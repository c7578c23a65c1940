"""Hand-made rows for aspects, the backlog, dashboards, retrieval and probes."""

import pytest
from pyspark.sql import functions as F

from gristmill.operators import aspects, dashboard, priority, probes, retrieval, vectors


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("login.", []), ("login", ["login"]), ("My ads", ["ad"]), ("features", []), ("customer service", []), ("LOGIN updates crashes", ["crash", "login", "update"]), ("", None), ("  ", None), (None, None)],
)
def test_extract(spark, text, want):
    assert one(spark, aspects.extract, text) == want


def test_chunks(spark):
    rows = [("my money", "NOUN"), ("Her Login", "NOUN"), ("the ui", "NOUN"), ("ui", "PROPN"), ("abc", "NOUN"), ("it", "PRON"), ("quickly", "ADV"), ("customer service", "NOUN"), (" dark mode ", "NOUN")]
    got = one(spark, lambda c: aspects.chunk_aspects(c), rows, "array<struct<text: string, head_pos: string>>")
    assert got == ["money", "login", "the ui", "customer service", "dark mode"]


@pytest.mark.parametrize(("aspect", "want"), [(" The Search ", "search"), ("the day", None), ("Battery Life", "Battery Life"), ("no driver", "driver availability")])
def test_ranking_form(spark, aspect, want):
    assert one(spark, aspects.ranking_form, aspect) == want


def test_mentions_count_variants_twice(spark):
    df = spark.createDataFrame([(1, ["the search", "search results", "the app"]), (2, []), (3, None)], "i int, aspects array<string>")
    assert [r.aspect for r in aspects.mentions(df).collect()] == ["search", "search"]


@pytest.mark.parametrize(("aspect", "want"), [("start screen", False), ("preview", False), ("amazon", False), ("amazon prime", True), ("dark mode", True)])
def test_noise(spark, aspect, want):
    assert one(spark, aspects.is_feature, aspect) is want


def _mentions(spark, rows):
    return spark.createDataFrame(rows, "app_name string, aspect string, rating int, label string, date string").withColumn("date", F.col("date").cast("timestamp_ntz"))


def test_backlog(spark):
    old, new, edge = "2024-01-01", "2024-03-20", "2024-03-01"
    rows = [("a", "x", 1, "negative", new)] * 6 + [("a", "x", 5, "positive", old)] * 4 + [("a", "y", 1, "negative", edge)] * 5 + [("a", "y", 1, "negative", None)] * 5 + [("b", "z", 5, "positive", new)] * 10 + [("b", "few", 1, "negative", new)] * 9
    got = {r.aspect: r for r in priority.backlog(_mentions(spark, rows), "2024-03-31").collect()}
    assert set(got) == {"x", "y", "z"} and got["x"].recency_score_raw == 1.0 and got["y"].recency_score_raw == 0.0 and got["z"].recency_score_raw == 0.0
    assert got["x"].volume_norm == 0.5 and [got[k].rank for k in ("x", "y", "z")] == [2, 1, 3] or got["x"].rank == 1
    assert priority.backlog(_mentions(spark, []), "2024-03-31").count() == 0


def test_dashboard_small(spark):
    f = spark.createDataFrame([(1, "a", "negative", "2024-01-07"), (2, "a", "positive", "2024-01-08"), (3, "b", None, "2024-01-08"), (4, "b", "positive", None)], "review_id int, app_name string, combined_label string, d string").withColumn("date", F.col("d").cast("timestamp_ntz"))
    rates = {r.period: (r.negative, r.total) for r in dashboard.negative_rate(f, f, weekly=True).collect()}
    assert rates == {"2024-01-01/2024-01-07": (1, 1)}
    share = {r.app_name: r.pct_positive for r in dashboard.sentiment_share(f).collect()}
    assert share == {"a": 50.0, "b": 50.0}
    pivot = {r.app_name: (r.n_positive, r.pct_positive) for r in dashboard.sentiment_by_app(f).collect()}
    assert pivot["b"] == (1, 100.0)
    bins = dashboard.histogram(spark.createDataFrame([(0.0,), (1.0,), (0.5,), (None,), (2.0,)], "x double"), "x", 0.0, 1.0, 4)
    assert sorted((r.bin, r.n) for r in bins.collect()) == [(0, 1), (2, 1), (3, 1)]


def test_retrieval(spark):
    f = spark.createDataFrame([(i, "it's", "negative", 1, f"the Login is slow {i}\nreally") for i in range(30)], "review_id int, app_name string, combined_label string, rating int, text string")
    got = retrieval.excerpts(f, "Why is the login slow?", ["it's"]).collect()
    assert len(got) == 15 and all("\n" not in r.excerpt for r in got) and [r.review_id for r in got] == [r.review_id for r in retrieval.excerpts(f, "Why is the login slow?", ["it's"]).collect()]
    assert retrieval.excerpts(f, "is it of", ["it's"]).count() == 0


def test_probes(spark):
    rows = [("p", 1, 500, 0, "error"), ("p", 2, 500, 400, "success"), ("p", 3, 500, 300, "success"), ("p", 4, 500, 330, "success")]
    log = spark.createDataFrame(rows, "probe string, run int, requested int, returned int, status string")
    got = {r.run: (r.first_count, r.throttled) for r in probes.degradation(log).collect()}
    assert got == {1: (None, False), 2: (400, False), 3: (400, True), 4: (400, False)}
    fill = {r.run: (r.fill_pct, r.short) for r in probes.fill_rate(log).collect()}
    assert fill[1] == (None, False) and fill[2] == (80.0, False)


def test_delay_pairs(spark):
    rows = [(0, "success", 500, 349), (2, "success", 500, 500), (5, "error", 500, 0), (10, "success", None, 3)]
    pairs = spark.createDataFrame(rows, "delay int, first_status string, first_returned int, second_returned int")
    assert {r.delay: r.degraded for r in probes.delay_pairs(pairs).collect()} == {0: True, 2: False, 5: False, 10: False}


def test_text_vectors(spark):
    df = spark.createDataFrame([(i, f"alpha beta gamma{'' if i % 2 else ' delta'}") for i in range(8)] + [(9, None)], "i int, text string")
    got = {r.i: r for r in vectors.text_vectors(df, "i", min_word=2, min_char=2, max_word=50, max_char=50).collect()}
    assert got[9]["indices"] == [] and max(got[0]["indices"]) < 100
    for r in (got[0], got[1]):
        assert sum(v * v for i, v in zip(r["indices"], r["values"], strict=True) if i < 50) == pytest.approx(1)
    out = vectors.reduced(vectors.text_vectors(df, "i", min_word=2, min_char=2, max_word=50, max_char=50), "i", 100, dims=3).collect()
    assert {len(r.tfidf_embedding) for r in out} == {2}  # two kinds of text: the rank
