"""The issue backlog: severity, volume and recency of each (app, aspect)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.numeric import min_max_or_half, rounded, share
from gristmill.operators.aspects import is_feature

WEIGHTS = {"sentiment_norm": 0.40, "volume_norm": 0.35, "recency_norm": 0.25}
RECENT_DAYS = 30
LEAST_MENTIONS = 10


def aspect_stats(mentions: DataFrame, as_of: str, days: int = RECENT_DAYS) -> DataFrame:
    """mentions (app_name, aspect, rating, label, date) to counts and rates; one shuffle of partial sums."""
    neg = F.col("label") == "negative"
    recent = F.coalesce(F.col("date") > F.expr(f"timestamp_ntz'{as_of}' - interval '{int(days)}' day"), F.lit(False))
    stats = mentions.groupBy("app_name", "aspect").agg(
        F.count(F.lit(1)).alias("mention_count"),
        F.count_if(neg).alias("negative_count"),
        F.count_if(F.col("label") == "positive").alias("positive_count"),
        F.count_if(neg & recent).alias("recent_negatives"),
        F.sum("rating").alias("rating_sum"),
        F.count("rating").alias("rated"),
    )
    return stats.select(
        "app_name", "aspect", "mention_count", "negative_count", "positive_count",
        rounded(share(F.col("negative_count"), F.col("mention_count")), 3).alias("negative_rate"),
        rounded(share(F.col("rating_sum"), F.col("rated")), 2).alias("avg_rating"),
        rounded(F.coalesce(share(F.col("recent_negatives"), F.nullif("negative_count", F.lit(0).cast("bigint"))), F.lit(0.0)), 3).alias("recency_score_raw"),
    )


def backlog(mentions: DataFrame, as_of: str, least: int = LEAST_MENTIONS, features_only: bool = True) -> DataFrame:
    """The ranked backlog. Rates are scaled over the survivors of all apps."""
    stats = aspect_stats(mentions, as_of).where(F.col("mention_count") >= least)
    if features_only:
        stats = stats.where(is_feature(F.col("aspect")))
    stats = stats.withColumn("mention_volume", F.col("mention_count").cast("double"))
    scaled = min_max_or_half(stats, {"negative_rate": "sentiment_norm", "mention_volume": "volume_norm", "recency_score_raw": "recency_norm"}).drop("mention_volume")
    score = sum((F.lit(w) * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    return ranked(scaled.withColumn("priority_score", rounded(score, 4)))


def ranked(scored: DataFrame) -> DataFrame:
    """Dense 1-based ranks; ties by app, then aspect. Over aggregated rows only."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.col("priority_score").desc(), "app_name", "aspect")))


def best_per_app(backlog_rows: DataFrame) -> DataFrame:
    """The first issue of each app."""
    w = Window.partitionBy("app_name").orderBy(F.col("priority_score").desc(), "aspect")
    return backlog_rows.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def top(backlog_rows: DataFrame, n: int) -> DataFrame:
    return backlog_rows.orderBy("rank").limit(n)
