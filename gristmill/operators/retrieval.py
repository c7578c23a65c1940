"""Rows and figures that ground an answer to a question."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import contains_any, preview, question_keywords
from gristmill.operators.dashboard import sentiment_share, top_negative_aspects

KEYWORDS, EXCERPTS, WIDTH = 4, 15, 200


def matches(features: DataFrame, question: str, apps: list[str], label: str | None = "negative") -> DataFrame:
    """Rows of the apps (and label) whose text holds one of the first keywords; none if the question has no keyword."""
    words = question_keywords(question)[:KEYWORDS]
    rows = features.where(F.col("app_name").isin(*apps))
    if label:
        rows = rows.where(F.col("combined_label") == label)
    return rows.where(contains_any(F.lower("text"), words) if words else F.lit(False))


def sample(rows: DataFrame, n: int, key: str = "review_id", seed: int = 42) -> DataFrame:
    """n rows in an order that depends on the key and the seed alone."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def excerpts(features: DataFrame, question: str, apps: list[str], n: int = EXCERPTS, seed: int = 42) -> DataFrame:
    rows = sample(matches(features, question, apps), n, seed=seed)
    return rows.select("review_id", "app_name", "rating", preview(F.col("text"), WIDTH).alias("excerpt"))


def context(reviews: DataFrame, features: DataFrame, backlog: DataFrame, apps: list[str]) -> DataFrame:
    """(section, app_name, item, value) rows that a prompt is made of."""
    own = lambda df: df.where(F.col("app_name").isin(*apps))
    none = F.lit(None).cast("string")
    row = lambda df, section, app, item, value: df.select(F.lit(section).alias("section"), app.alias("app_name"), item.alias("item"), value.cast("double").alias("value"))
    shares = sentiment_share(own(features))
    parts = [
        row(reviews.agg(F.count(F.lit(1)).alias("n")), "total", none, F.lit("reviews"), F.col("n")),
        row(shares, "sentiment", F.col("app_name"), F.lit("positive_pct"), F.col("pct_positive")),
        row(shares, "sentiment", F.col("app_name"), F.lit("negative_pct"), F.col("pct_negative")),
        row(top_negative_aspects(own(features)), "negative_aspect", F.col("app_name"), F.col("aspect"), F.col("n")),
        row(own(backlog).orderBy("rank").limit(5), "issue", F.col("app_name"), F.col("aspect"), F.col("priority_score")),
    ]
    return reduce(DataFrame.unionByName, parts)


def context_text(rows: list) -> str:
    """The rows of `context`, a few dozen, as lines."""
    out, section = [], None
    for r in sorted(rows, key=lambda r: (["total", "sentiment", "negative_aspect", "issue"].index(r.section), r.app_name or "", -r.value)):
        if r.section != section:
            section = r.section
            out.append(f"# {section}")
        out.append(": ".join([*[x for x in (r.app_name, r.item) if x], f"{r.value:g}"]))
    return "\n".join(out) + "\n"


