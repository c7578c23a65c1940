"""Labels from ratings and text scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.numeric import share
from gristmill.functions.text import py_strip

EDGE = 0.1


def _by_score(score: Column) -> Column:
    return F.when(score >= EDGE, "positive").when(score <= -EDGE, "negative").otherwise("neutral")


def rating_signal(rating: Column) -> Column:
    """(V5)"""
    return F.when(rating.isNull(), F.lit(None)).when(rating <= 2, "negative").when(rating >= 4, "positive").otherwise("neutral")


def is_blank(text: Column) -> Column:
    return F.coalesce(py_strip(text) == "", F.lit(True))


def text_label(text: Column, rating: Column, compound: Column) -> tuple[Column, Column, Column]:
    """(label, method, compound): the rating decides unless it is 3 or missing; blank text has none. (V1)"""
    rated = (rating <= 2) | (rating >= 4)
    label = F.when(rated, rating_signal(rating)).otherwise(_by_score(F.coalesce(compound, F.lit(0.0))))
    filled = ~is_blank(text)
    return F.when(filled, label), F.when(filled, F.when(rated, "rating").otherwise("vader_text")), F.when(filled, compound)


def blend(rating: Column, compound: Column, length: Column) -> tuple[Column, Column, Column]:
    """(label, unrounded score, weight of the rating): short texts lean on the rating. (V2)"""
    star = (rating.cast("double") - 3.0) / 2.0
    w = F.when(length < 20, 0.9).when(length < 100, 0.7).otherwise(0.5)
    rest = F.when(length < 20, 0.1).when(length < 100, 0.3).otherwise(0.5)
    score = w * star + rest * F.coalesce(compound, F.lit(0.0))
    return _by_score(score), score, w


def with_labels(reviews: DataFrame) -> DataFrame:
    """reviews (text, rating, compound, ...) with the text label, the blend and the rating's own signal."""
    label, method, _ = text_label(F.col("text"), F.col("rating"), F.col("compound"))
    combined, score, w = blend(F.col("rating"), F.col("compound"), F.length(F.coalesce("text", F.lit(""))))
    return reviews.withColumns({"vader_label": label, "vader_method": method, "combined_label": combined, "combined_score": score, "combined_weight_rating": w, "rating_signal": rating_signal(F.col("rating"))})


def disagreement(labelled: DataFrame) -> DataFrame:
    """Labels that differ, nulls being different from anything."""
    differ = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(True))
    return labelled.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(differ("vader_label", "combined_label")).alias("n_differ"),
        share(F.count_if(differ("vader_label", "combined_label")), F.count(F.lit(1))).alias("share_differ"),
        F.count_if(differ("combined_label", "rating_signal")).alias("n_rating_conflict"),
    )
