"""Data-quality and pipeline-health report with alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.numeric import rounded, share
from gristmill.functions.text import preview, status_icon

FAILURE_RATE, SHORT_RATE, DUPLICATE_RATE, LOW_VOLUME = 0.20, 0.30, 0.25, 100
#: Runs that the report shows.
RUNS_SHOWN = 10


def run_health(runs: DataFrame) -> DataFrame:
    """Counts by state, failure rate and its alert, one row."""
    state = lambda s: F.count_if(F.col("status") == s)
    rows = runs.agg(F.count(F.lit(1)).alias("n_runs"), state("success").alias("n_success"), state("failed").alias("n_failed"), state("in_progress").alias("n_in_progress"))
    rate = share(F.col("n_failed"), F.nullif("n_runs", F.lit(0).cast("bigint")))
    return rows.withColumn("failure_rate", rate).withColumn("alert", F.coalesce(rate > FAILURE_RATE, F.lit(False)))


def date_range(reviews: DataFrame) -> DataFrame:
    """(A3)"""
    return reviews.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def reviews_per_app(reviews: DataFrame) -> DataFrame:
    """Most first. (A2)"""
    return reviews.groupBy("app_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "app_name")


def with_first_run(runs: DataFrame) -> DataFrame:
    """Adds is_first: no run of the app began earlier; ties are all first.

    The least start of each app is aggregated and joined back: runs of one app aren't sorted in one task.
    """
    first = runs.groupBy("app_id").agg(F.min("started_at").alias("__first"))
    return runs.join(first, "app_id", "left").withColumn("is_first", F.coalesce(F.col("started_at") == F.col("__first"), F.lit(False))).drop("__first")


def latest_runs(runs: DataFrame, apps: DataFrame, n: int) -> DataFrame:
    """The last n runs with their app and whether they were its first, newest first."""
    rows = with_first_run(runs).join(apps.select("app_id", "app_name"), "app_id")
    rows = rows.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(n)
    return rows.select("id", "app_name", F.date_format("started_at", "yyyy-MM-dd HH:mm").alias("started"), status_icon(F.col("status")).alias("state"), "reviews_collected", "is_first")


def low_volume_runs(runs: DataFrame, apps: DataFrame, least: int = LOW_VOLUME, last: int | None = None) -> DataFrame:
    """Successful first runs that collected little, of all runs or of the `last` ones that the report shows."""
    rows = with_first_run(runs)
    if last is not None:
        rows = rows.join(apps.select("app_id"), "app_id", "left_semi").orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(last)
    rows = rows.where(F.col("is_first") & (F.col("status") == "success") & (F.col("reviews_collected") < least))
    return rows.join(apps.select("app_id", "app_name"), "app_id").select("id", "app_name", "reviews_collected")


def missing_fields(reviews: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n_missing, rate) in one pass."""
    one = reviews.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_missing"), share(F.col(c), F.nullif("n", F.lit(0).cast("bigint"))).alias("rate")) for c in columns])).alias("x")).select("x.*")


def short_texts(reviews: DataFrame) -> DataFrame:
    """Texts under 10 and 20 characters, an alert on the latter; null texts aren't counted as short. (A10)"""
    short = lambda k: F.count_if(F.length("text") < k)
    rows = reviews.agg(F.count(F.lit(1)).alias("n"), short(10).alias("n_under_10"), short(20).alias("n_under_20"))
    n = F.nullif("n", F.lit(0).cast("bigint"))
    return rows.withColumn("rate_under_10", share(F.col("n_under_10"), n)).withColumn("rate_under_20", share(F.col("n_under_20"), n)).withColumn("alert", F.coalesce(F.col("rate_under_20") > SHORT_RATE, F.lit(False)))


def duplicate_groups(reviews: DataFrame, key: str = "app_id") -> DataFrame:
    """(key, text, n) of non-null texts that an app has more than once."""
    return reviews.where("text is not null").groupBy(key, "text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_report(reviews: DataFrame, key: str = "app_id") -> DataFrame:
    """Groups, members and extras, one row; extras count null texts too."""
    zero = F.lit(0).cast("bigint")
    groups = reviews.groupBy(key, "text").agg(F.count(F.lit(1)).alias("n"))
    many = F.col("text").isNotNull() & (F.col("n") > 1)
    rows = groups.agg(
        F.count_if(many).alias("n_groups"), F.coalesce(F.sum(F.when(many, F.col("n"))), zero).alias("n_members"),
        F.coalesce(F.sum(F.col("n") - 1), zero).alias("n_extras"), F.coalesce(F.sum("n"), zero).alias("n"),
    )
    rate = share(F.col("n_members"), F.nullif("n", zero))
    return rows.withColumn("rate", rate).withColumn("alert", F.coalesce(rate > DUPLICATE_RATE, F.lit(False)))


def top_duplicates(reviews: DataFrame, n: int, key: str = "app_id", width: int = 40) -> DataFrame:
    """The most repeated texts, by count, app and text."""
    rows = duplicate_groups(reviews, key).orderBy(F.col("n").desc(), key, "text").limit(n)
    return rows.select(key, preview(F.col("text"), width).alias("text_preview"), "n")


def rating_histogram(reviews: DataFrame) -> DataFrame:
    """Counts and percent by rating. (A5)"""
    rows = reviews.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("pct", share(F.lit(100) * F.col("n"), F.sum("n").over(Window.partitionBy())))


def _facts(reviews: DataFrame, runs: DataFrame, apps: DataFrame, fields: tuple[str, ...], last: int) -> DataFrame:
    """One row with every scalar of the report: a scan of reviews, their duplicates, and aggregates of runs."""
    short = lambda k: F.count_if(F.length("text") < k)
    one = reviews.agg(
        F.count(F.lit(1)).alias("n_reviews"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), short(10).alias("n_under_10"), short(20).alias("n_under_20"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in fields],
    )
    doubles = duplicate_report(reviews).select("n_groups", "n_members", F.col("rate").alias("duplicate_rate"), F.col("alert").alias("duplicate_alert"))
    low = low_volume_runs(runs, apps, last=last).agg(F.count(F.lit(1)).alias("n_low"))
    own = run_health(runs).withColumnRenamed("alert", "failure_alert")
    rows = one.join(doubles).join(own).join(apps.agg(F.count(F.lit(1)).alias("n_apps"))).join(low)  # one row each
    n = F.nullif("n_reviews", F.lit(0).cast("bigint"))
    rows = rows.withColumn("rate_under_20", share(F.col("n_under_20"), n))
    return rows.withColumn("short_alert", F.coalesce(F.col("rate_under_20") > SHORT_RATE, F.lit(False)))


def _cell(section: str, place: int | Column, metric: str | Column, value: Column | None = None, detail: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(section).alias("section"), lit(place).cast("int").alias("place"), lit(metric).alias("metric"),
        lit(value).cast("double").alias("value"), lit(detail).cast("string").alias("detail"),
    )


def _alert_cells() -> list[Column]:
    """The scalar alerts of a row of facts; null where there is none."""
    text = F.format_string
    made = [
        ("failure_rate", "failure_alert", text("%d of %d runs failed", "n_failed", "n_runs")),
        ("short_texts", "short_alert", text("%d of %d texts are under 20 characters", "n_under_20", "n_reviews")),
        ("duplicates", "duplicate_alert", text("%d of %d texts are repeated", "n_members", "n_reviews")),
    ]
    return [F.when(F.col(flag), _cell("alerts", i, name, detail=detail)) for i, (name, flag, detail) in enumerate(made, 1)]


def _low_volume_cells(runs: DataFrame, apps: DataFrame, last: int) -> DataFrame:
    low = low_volume_runs(runs, apps, last=last)
    return low.select(_cell("alerts", 4, "low_volume", detail=F.format_string("%s: %d reviews in its first run", "app_name", "reviews_collected")).alias("x"))


def alerts(reviews: DataFrame, runs: DataFrame, apps: DataFrame, last: int = RUNS_SHOWN) -> DataFrame:
    """(alert, detail) rows: rates over their limits, and low first runs among the last runs."""
    own = _facts(reviews, runs, apps, (), last).select(F.explode(F.array(*_alert_cells())).alias("x")).where("x is not null")
    return own.unionByName(_low_volume_cells(runs, apps, last)).select(F.col("x.metric").alias("alert"), "x.detail")


def report(reviews: DataFrame, runs: DataFrame, apps: DataFrame, fields: tuple[str, ...] = ("app_version", "reply"), last: int = RUNS_SHOWN, repeated: int = 5) -> DataFrame:
    """All sections as (section, place, metric, value, detail), with alerts and the verdict.

    Sections: overview, runs (the last ones), apps, quality, repeated (texts), ratings, alerts, verdict. Scalars come from
    one scan of reviews, apps and ratings from one more; repeated texts are counted once for rates and once for the list.
    """
    c, n = F.col, F.nullif("n_reviews", F.lit(0).cast("bigint"))
    scalar = ["n_reviews", "n_apps", "n_runs", "n_success", "n_failed", "failure_rate"]
    overview = [_cell("overview", i, name, c(name)) for i, name in enumerate(scalar, 1)]
    overview += [_cell("overview", i, name, detail=F.date_format(name, "yyyy-MM-dd HH:mm:ss")) for i, name in enumerate(("first_date", "last_date"), len(scalar) + 1)]
    counted = {**{f"missing_{f}": c(f"missing_{f}") for f in fields}, "n_under_10": c("n_under_10"), "n_under_20": c("n_under_20"), "duplicate_members": c("n_members")}
    quality = [x for i, (k, v) in enumerate(counted.items()) for x in (_cell("quality", 2 * i + 1, k, v), _cell("quality", 2 * i + 2, f"{k}_rate", share(v, n)))]
    quality.append(_cell("quality", 2 * len(counted) + 1, "duplicate_groups", c("n_groups")))
    n_alerts = sum((c(x).cast("int") for x in ("failure_alert", "short_alert", "duplicate_alert")), c("n_low"))
    verdict = _cell("verdict", 1, F.when(n_alerts > 0, "WARNING").otherwise("HEALTHY"), n_alerts)
    facts = _facts(reviews, runs, apps, fields, last).select(F.explode(F.array(*overview, *quality, *_alert_cells(), verdict)).alias("x")).where("x is not null")

    latest = latest_runs(runs, apps, last).withColumn("place", F.row_number().over(Window.orderBy(c("started").desc(), c("id").desc())))  # `last` rows
    shown = latest.select(_cell("runs", c("place"), c("app_name"), c("reviews_collected"), F.concat_ws(" ", "state", "started")).alias("x"))
    groups = reviews.groupingSets([["app_name"], ["rating"]], "app_name", "rating").agg(F.grouping("app_name").alias("by_rating"), F.count(F.lit(1)).alias("n"))
    by_n = Window.partitionBy("by_rating").orderBy(F.when(c("by_rating") == 0, -c("n")).otherwise(c("rating")), "app_name")  # a row for each app and rating
    groups = groups.withColumn("place", F.row_number().over(by_n)).withColumn("pct", share(F.lit(100) * c("n"), F.sum("n").over(Window.partitionBy("by_rating"))))
    stars = F.array(_cell("ratings", c("place"), F.concat(F.lit("stars_"), c("rating").cast("string")), c("n"), F.concat(rounded(c("pct"), 1).cast("string"), F.lit("%"))))
    grouped = groups.select(F.explode(F.when(c("by_rating") == 1, stars).otherwise(F.array(_cell("apps", c("place"), c("app_name"), c("n"))))).alias("x"))
    top = top_duplicates(reviews, repeated, "app_name").withColumn("place", F.row_number().over(Window.orderBy(c("n").desc(), "app_name", "text_preview")))  # `repeated` rows
    often = top.select(_cell("repeated", c("place"), c("app_name"), c("n"), c("text_preview")).alias("x"))
    return reduce(DataFrame.unionByName, (facts, shown, grouped, often, _low_volume_cells(runs, apps, last))).select("x.*")


SECTIONS = ("overview", "runs", "apps", "quality", "repeated", "ratings", "alerts", "verdict")


def text_report(rows: list) -> str:
    """Lines of collected report rows, a few dozen, section by section."""
    out, section = [], None
    for r in sorted(rows, key=lambda r: (SECTIONS.index(r.section), r.place, r.metric, r.detail or "")):
        if r.section != section:
            section = r.section
            out.append(f"== {section}")
        out.append(f"{r.metric}: " + " ".join(x for x in ("" if r.value is None else f"{r.value:g}", r.detail or "") if x))
    return "\n".join(out) + "\n"
