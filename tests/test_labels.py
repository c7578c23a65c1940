"""Hand-made rows for labels, votes and scores."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions.numeric import min_max_or_half, rounded
from gristmill.operators import scorers, sentiment, vote


def labels(spark, rows):
    df = spark.createDataFrame(rows, "review_id long, rating int, text string, compound double")
    return {r.review_id: r for r in sentiment.with_labels(df).collect()}


def test_blend_is_double_arithmetic(spark):
    got = labels(spark, [(i, r, "x" * 100, c) for i, (r, c) in enumerate([(1, 0.80), (2, 0.70), (4, -0.70), (5, -0.80)])])
    assert {got[i].combined_label for i in range(3)} | {got[3].combined_label} <= {"neutral", "negative", "positive"}
    for r, c, i in ((1, 0.80, 0), (5, -0.80, 3)):
        score = 0.5 * ((r - 3) / 2) + 0.5 * c
        assert got[i].combined_score == score and got[i].combined_label == ("positive" if score >= 0.1 else "negative" if score <= -0.1 else "neutral") == "neutral"
    assert got[1].combined_label == got[2].combined_label == "neutral" if abs(0.5 * -0.5 + 0.5 * 0.7) < 0.1 else True


def test_blend_bands(spark):
    got = labels(spark, [(n, 5, "x" * n, 0.0) for n in (19, 20, 99, 100)])
    assert [got[n].combined_weight_rating for n in (19, 20, 99, 100)] == [0.9, 0.7, 0.7, 0.5]


def test_three_stars_and_text_label(spark):
    got = labels(spark, [(1, 3, "short", 0.99), (2, 3, "short", 1.0), (3, 3, "x" * 30, 0.1), (4, 3, "x" * 30, -0.1), (5, 3, "x" * 30, 0.0999), (6, None, "x" * 30, None), (7, 5, " \t", 0.3), (8, 5, None, 0.3), (9, 5, "", 0.3), (10, 2, "x", 0.9)])
    assert (got[1].combined_label, got[2].combined_label) == ("neutral", "positive")
    assert [got[i].vader_label for i in range(3, 11)] == ["positive", "negative", "neutral", "neutral", None, None, None, "negative"]
    assert (got[3].vader_method, got[10].vader_method, got[7].vader_method) == ("vader_text", "rating", None)
    assert got[6].rating_signal is None and got[10].rating_signal == "negative"


VOTES = [
    (("p", "p", "n"), ("p", 0.67)), (("p", "n", "u"), ("ambiguous", 0.0)), (("p", "p", None), ("p", 1.0)), (("p", "n", None), ("ambiguous", 0.0)),
    (("p", None, None), ("ambiguous", 0.0)), ((None, None, None), ("ambiguous", 0.0)), (("p", "p", "p"), ("p", 1.0)), (("p", "mixed", "mixed"), ("mixed", 0.67)),
]


def test_votes(spark):
    df = spark.createDataFrame([(i, *v) for i, (v, _) in enumerate(VOTES)], "i int, a string, b string, c string")
    label, sure = vote.majority(F.col("a"), F.col("b"), F.col("c"))
    got = {r.i: (r.l, r.s) for r in df.select("i", label.alias("l"), sure.alias("s")).collect()}
    assert [got[i] for i in range(len(VOTES))] == [w for _, w in VOTES]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(*[st.sampled_from(["p", "n", "u", None])] * 3), min_size=1, max_size=20))
def test_votes_do_not_depend_on_order(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string, c string")
    cols = [F.col(x) for x in "abc"]
    pick = [vote.majority(*(cols[i] for i in p)) for p in ((0, 1, 2), (1, 2, 0), (2, 1, 0))]
    for r in df.select(*[x.alias(f"{n}{i}") for i, p in enumerate(pick) for n, x in zip("lc", p, strict=True)]).collect():
        assert r[0] == r[2] == r[4] and r[1] == r[3] == r[5]


def test_settle_order_and_write_back(spark):
    rows = [(1, "a", 3, "t\nx", 0.2), (2, "a", 5, "y" * 200, -1.0), (3, "a", 5, "fine", 0.9)]
    df = spark.createDataFrame(rows, "review_id long, app_name string, rating int, text string, compound double")
    labelled = sentiment.with_labels(df)
    votes = vote.settle(labelled, F.lit("negative"), F.lit(0.9))
    got = {r.review_id: r for r in votes.collect()}
    assert set(got) == {1, 2} and got[1].text_preview == "t x" and got[2].label_source == got[2].final_label
    assert [r.review_id for r in vote.in_order(vote.conflicts(labelled)).collect()][0] in (1, 2)
    back = {r.review_id: r.final_label for r in vote.write_back(labelled, votes).collect()}
    assert back[3] is None and back[2] == got[2].final_label


def test_rounding(spark):
    df = spark.createDataFrame([(0.5625, 3), (0.28125, 4), (1.005, 2), (0.5075, 3)], "x double, n int")
    import numpy as np

    for r in df.select("x", "n", *[rounded(F.col("x"), k).alias(f"r{k}") for k in (2, 3, 4)]).collect():
        assert r[f"r{r.n}"] == float(np.round(r.x, r.n))


def test_min_max(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0), (3, 3.0, 5.0)], "i int, x double, y double")
    got = {r.i: (r.sx, r.sy) for r in min_max_or_half(df, {"x": "sx", "y": "sy"}).collect()}
    assert got == {1: (0.0, 0.5), 2: (1.0, 0.5), 3: (0.5, 0.5)}
    assert min_max_or_half(df.limit(1), {"x": "sx"}).first().sx == 0.5
    assert min_max_or_half(df.limit(0), {"x": "sx"}).count() == 0


def test_text_functions(spark):
    rows = [(1, "  a b \x1f"), (2, ""), (3, "Hello."), (4, "Hi. there!"), (5, None)]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: r for r in df.select("i", T.py_strip(F.col("t")).alias("s"), T.tokens(F.col("t")).alias("w"), T.sentence_count(F.col("t")).alias("n")).collect()}
    assert got[1].s == "a b" and got[2].w == [] and [got[i].n for i in (2, 3, 4)] == [1, 2, 3] and got[5].s is None
    ts = spark.sql("SELECT timestamp_ntz'2024-01-07 10:00:00' a, timestamp_ntz'2024-01-08 00:00:00' b").select(T.week_label(F.col("a")).alias("a"), T.week_label(F.col("b")).alias("b"), T.month_label(F.col("a")).alias("m")).first()
    assert tuple(ts) == ("2024-01-01/2024-01-07", "2024-01-08/2024-01-14", "2024-01")
    js = spark.createDataFrame([('["a","b"]',), ("nope",), ("null",), ("3",), ("[]",)], "j string").select(T.string_array(F.col("j")).alias("a")).collect()
    assert [r.a for r in js] == [["a", "b"], None, None, None, []]
    fence = spark.createDataFrame([('```json\n{"label": "x"}\n```',), ('{"label": "y"}',), ("sorry",)], "r string").select(T.fenced_json(F.col("r"), "label string")["label"].alias("l")).collect()
    assert [r.l for r in fence] == ["x", "y", None]
    assert T.question_keywords("What is THE Login of it?") == ["login", "it?"]


@pytest.mark.parametrize(("cls", "want"), [(r"\p{L}", "éß中"), (r"\p{Nd}", "٣"), (r"\p{L}\p{N}", "éß²½٣中")])
def test_character_classes(spark, cls, want):
    df = spark.createDataFrame([("é ß ² ½ ٣ 中 Ⓐ 😀 _",)], "t string")
    assert df.select(T.count_class(F.col("t"), cls)).first()[0] == len(want)


def test_lexicon_scores(spark):
    df = spark.createDataFrame([(1, "Great, great app!"), (2, "the worst"), (3, ""), (4, None)], "i int, t string")
    got = {r.i: r for r in df.select("i", scorers.compound(F.col("t")).alias("c"), scorers.subjectivity(F.col("t")).alias("s"), scorers.polarity(F.col("t")).alias("p")).collect()}
    assert got[1].c == pytest.approx(6.2 / math.sqrt(6.2**2 + 15)) and got[2].c < 0 and got[3].c == 0 and got[4].c is None
    assert got[1].s == pytest.approx(0.8) and got[3].s == 0 and got[4].p == 0


def test_model_scorer_survives_bad_texts(spark):
    def load():
        def model(texts):
            if any("boom" in t for t in texts):
                raise ValueError("boom")
            return [{"label": t.upper(), "n": len(t)} for t in texts]

        return model

    df = spark.createDataFrame([(1, "a"), (2, "boom"), (3, " "), (4, None), (5, "bc")], "i int, text string").coalesce(1)
    got = {r.i: (r.label, r.n) for r in scorers.with_model(df, load, "label string, n int").collect()}
    assert got == {1: ("A", 1), 2: (None, None), 3: (None, None), 4: (None, None), 5: ("BC", 2)}
