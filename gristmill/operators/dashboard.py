"""Read-only analytics over reviews, features, runs and the backlog."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.numeric import rounded, share
from gristmill.functions.text import month_label, percent, preview, week_label

LABELS = ("positive", "neutral", "negative")


def _count(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def app_filter(rows: DataFrame, apps: list[str], column: str = "app_name") -> DataFrame:
    """Rows of the chosen apps; values are passed as literals, no SQL text is built."""
    return rows.where(F.col(column).isin(*apps))


def app_list(apps: DataFrame) -> DataFrame:
    """(T10)"""
    return apps.select("app_name").distinct().orderBy("app_name")


def overview(reviews: DataFrame, features: DataFrame, runs: DataFrame) -> DataFrame:
    """Tiles: reviews, apps, runs, negative percent; one row of three one-row aggregates."""
    a = reviews.agg(_count("n_reviews"), F.count_distinct("app_name").alias("n_apps"))
    b = features.agg(F.count_if(F.col("combined_label") == "negative").alias("n_negative"), _count("n_features"))
    c = runs.agg(_count("n_runs"))
    out = a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each
    pct = share(F.lit(100) * F.col("n_negative"), F.nullif("n_features", F.lit(0).cast("bigint")))
    return out.select("n_reviews", "n_apps", "n_runs", pct.alias("negative_pct"))


def label_counts(features: DataFrame, column: str = "combined_label") -> DataFrame:
    """Values and how often, most first."""
    return features.groupBy(F.col(column).alias("value")).agg(_count()).orderBy(F.col("n").desc(), "value")


def sentiment_by_app(features: DataFrame) -> DataFrame:
    """Share of each label for each app, zeros filled; rows without a label don't count."""
    table = features.groupBy("app_name").agg(*[F.count_if(F.col("combined_label") == x).alias(f"n_{x}") for x in LABELS])
    total = sum((F.col(f"n_{x}") for x in LABELS), F.lit(0))
    return table.withColumns({f"pct_{x}": share(F.lit(100) * F.col(f"n_{x}"), F.nullif(total, F.lit(0).cast("bigint"))) for x in LABELS})


def sentiment_share(features: DataFrame) -> DataFrame:
    """Positive and negative share of all rows of an app, unlabelled ones included."""
    rows = features.groupBy("app_name").agg(_count(), *[F.count_if(F.col("combined_label") == x).alias(f"n_{x}") for x in ("positive", "negative")])
    return rows.withColumns({f"pct_{x}": share(F.lit(100) * F.col(f"n_{x}"), F.col("n")) for x in ("positive", "negative")})


def period(date: Column, weekly: bool) -> Column:
    return week_label(date) if weekly else month_label(date)


def trend(features: DataFrame, dates: DataFrame, weekly: bool = False) -> DataFrame:
    """(period, label) counts and their percent of the period: counts are aggregated before the window."""
    dated = features.select("review_id", "combined_label").join(dates.select("review_id", "date").where("date is not null"), "review_id")
    counts = dated.groupBy(period(F.col("date"), weekly).alias("period"), "combined_label").agg(_count()).where("combined_label is not null")
    total = F.sum("n").over(Window.partitionBy("period"))
    return counts.withColumn("pct", share(F.lit(100) * F.col("n"), total))


def negative_rate(features: DataFrame, dates: DataFrame, weekly: bool = False) -> DataFrame:
    """Negative percent of each period that has any."""
    dated = features.select("review_id", "combined_label").join(dates.select("review_id", "date").where("date is not null"), "review_id")
    rows = dated.groupBy(period(F.col("date"), weekly).alias("period")).agg(F.count_if(F.col("combined_label") == "negative").alias("negative"), _count("total"))
    return rows.where("negative > 0").withColumn("negative_pct", share(F.lit(100) * F.col("negative"), F.col("total")))


def conflict_rows(features: DataFrame, n: int = 20) -> DataFrame:
    """The first n rows whose two labels differ, under display names."""
    differ = F.coalesce(F.col("vader_label") != F.col("combined_label"), F.lit(True))
    rows = features.where(differ).orderBy("review_id").limit(n)
    return rows.select(F.col("app_name").alias("App"), F.col("rating").alias("Stars"), F.col("vader_label").alias("Text label"), F.col("combined_label").alias("Combined"), F.col("text").alias("Review text"))


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of `bins` equal bins over low..high; values outside and nulls aren't counted, `high` is in the last bin."""
    x = F.col(column).cast("double")
    width = (high - low) / bins
    k = F.least(F.floor((x - low) / F.lit(width)), F.lit(bins - 1).cast("bigint"))
    counts = rows.where(x.between(low, high)).groupBy(k.alias("bin")).agg(_count())
    return counts.withColumn("bin_start", F.lit(low) + F.col("bin") * F.lit(width))


def text_lengths(reviews: DataFrame) -> DataFrame:
    return reviews.select(F.length(F.coalesce("text", F.lit(""))).alias("text_len"))


def median_length(reviews: DataFrame) -> DataFrame:
    """The exact median of lengths, from counts of each length."""
    return text_lengths(reviews).agg(F.expr("percentile(text_len, 0.5)").alias("median"), F.expr("cast(percentile(text_len, 0.5) as int)").alias("label"))


def quality_tiles(reviews: DataFrame) -> DataFrame:
    """Short, repeated and missing texts; null texts count as short here, repeats are all but the first of a group."""
    length = F.length(F.coalesce("text", F.lit("")))
    rows = reviews.agg(_count(), F.count_if(length < 10).alias("n_under_10"), F.count_if(length < 20).alias("n_under_20"), F.count_if(F.col("text").isNull()).alias("n_missing"))
    groups = reviews.groupBy("app_name", "text").agg(_count("g")).agg(F.coalesce(F.sum(F.col("g") - 1), F.lit(0).cast("bigint")).alias("n_extras"))
    return rows.join(F.broadcast(groups))  # one row


def common_duplicates(reviews: DataFrame, n: int = 10) -> DataFrame:
    """(A9)"""
    rows = reviews.where("text is not null").groupBy("app_name", "text").agg(_count()).where("n > 1")
    return rows.orderBy(F.col("n").desc(), "app_name", "text").limit(n).select("app_name", preview(F.col("text"), 40).alias("text_preview"), "n")


def aspect_counts(features: DataFrame, n: int, aspects: str = "aspects") -> DataFrame:
    """The n aspects named most often, repeats included."""
    rows = features.select(F.explode(aspects).alias("aspect")).groupBy("aspect").agg(_count())
    return rows.orderBy(F.col("n").desc(), "aspect").limit(n)


def aspect_sentiment(features: DataFrame, n: int = 15, aspects: str = "aspects") -> DataFrame:
    """For each of the n top aspects, reviews that name it by label: one pass instead of one for each aspect."""
    top = aspect_counts(features, n, aspects).select("aspect")
    rows = features.select("combined_label", F.explode(F.array_distinct(aspects)).alias("aspect")).join(F.broadcast(top), "aspect")  # n rows
    counts = rows.groupBy("aspect").agg(_count("total"), *[F.count_if(F.col("combined_label") == x).alias(x) for x in LABELS])
    long = counts.select("aspect", "total", F.explode(F.array(*[F.struct(F.lit(x).alias("sentiment"), F.col(x).alias("n")) for x in LABELS])).alias("s"))
    return long.select("aspect", F.col("s.sentiment").alias("sentiment"), F.col("s.n").alias("n"), share(F.lit(100) * F.col("s.n"), F.col("total")).alias("pct"))


def top_negative_aspects(features: DataFrame, n: int = 5, aspects: str = "aspects") -> DataFrame:
    """The n aspects that an app's negative reviews name most."""
    rows = features.where(F.col("combined_label") == "negative").select("app_name", F.explode(aspects).alias("aspect")).groupBy("app_name", "aspect").agg(_count())
    place = F.row_number().over(Window.partitionBy("app_name").orderBy(F.col("n").desc(), "aspect"))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def backlog_tiles(backlog: DataFrame) -> DataFrame:
    """Issues, the app of the highest mean score (first by name on ties), mean negative rate."""
    per_app = backlog.groupBy("app_name").agg(F.avg("priority_score").alias("m"))
    best = per_app.orderBy(F.round("m", 9).desc(), "app_name").limit(1).select(F.col("app_name").alias("top_app"))
    rows = backlog.agg(_count("n_issues"), F.avg("negative_rate").alias("rate"))
    return rows.join(F.broadcast(best), how="left").select("n_issues", "top_app", percent(F.col("rate") * 100).alias("negative_rate"))  # one row


def backlog_display(backlog: DataFrame, n: int) -> DataFrame:
    """The first n issues with formatted figures and a joint label."""
    rows = backlog.orderBy("rank").limit(n)
    return rows.select(
        F.col("rank").alias("Rank"), F.concat_ws(" / ", "app_name", "aspect").alias("Issue"), rounded(F.col("priority_score"), 3).alias("Score"),
        percent(F.col("negative_rate") * 100).alias("Neg%"), F.col("mention_count").alias("Mentions"), rounded(F.col("avg_rating"), 2).alias("Avg rating"),
    )


def newest_runs(runs: DataFrame, n: int = 50) -> DataFrame:
    """The n newest runs, oldest of them first."""
    return runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(n).orderBy("started_at", "id")


class Cached:
    """A small result kept for LIFETIME_S seconds; after that the next call computes it again."""

    LIFETIME_S = 300.0

    def __init__(self, make: Callable[[], DataFrame], lifetime_s: float = LIFETIME_S, clock: Callable[[], float] = time.monotonic):
        self.make, self.lifetime_s, self.clock = make, lifetime_s, clock
        self.kept: DataFrame | None = None
        self.until = 0.0

    def __call__(self) -> DataFrame:
        if self.kept is None or self.clock() >= self.until:
            self.clear()
            self.kept, self.until = self.make().cache(), self.clock() + self.lifetime_s
        return self.kept

    def clear(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()
            self.kept = None
