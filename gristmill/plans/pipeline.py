"""The stages in order: ingest, features, health; then the backlog. Plain functions over a folder of tables.

Each stage reads and writes tables in `root`, so a stage that fails can run again. (O1, O2)
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill import schemas
from gristmill.functions.text import py_strip
from gristmill.operators import aspects, health, ingest, priority, scorers, sentiment
from gristmill.sources import tables

RETRIES, PAUSE_S = 1, 300.0
LEAST_CHARS = 10


def ingest_stage(spark: SparkSession, root: str, raw: DataFrame, started_at: str, completed_at: str, lang: str = "en", country: str = "us") -> None:
    """Add a raw batch of all apps and a run for each app.

    Runs are stored as in_progress first and finished once the reviews are; if that fails they end as failed, so that a
    retry adds runs of its own and no second success.
    """
    apps = tables.scan(spark, root, "apps")
    stored = tables.scan_optional(spark, root, "reviews", schemas.REVIEWS)
    past = tables.scan_optional(spark, root, "ingestion_runs", schemas.RUNS)
    batch = ingest.coerce(raw, lang, country, completed_at)
    counts = ingest.ingest_counts(batch, stored, apps)
    last_run = past.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    done = ingest.with_ids(ingest.finished_runs(apps, counts, started_at, completed_at), ["app_id"], start=last_run, ranges=4)
    done = done.select(*[F.col(f.name).cast(f.dataType) for f in schemas.RUNS])
    begun = done.withColumns({"status": F.lit("in_progress"), "completed_at": F.lit(None).cast("timestamp_ntz"), "reviews_collected": F.lit(0)})
    done = ingest.settled(done)
    done.count()  # the counts of this batch, before its reviews are stored
    tables.append_table(begun.select(*[F.col(f.name).cast(f.dataType) for f in schemas.RUNS]), root, "ingestion_runs")
    own = F.col("id") > last_run
    finish = done.select("id", "completed_at", "reviews_collected", "status")
    try:
        own_run = tables.scan(spark, root, "ingestion_runs").where(own).select("app_id", F.col("id").alias("__run"))
        rows = ingest.new_reviews(batch, stored, apps).drop("ingestion_run_id").join(own_run, "app_id", "left").withColumnRenamed("__run", "ingestion_run_id")
        last = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        rows = ingest.with_ids(rows.drop("seq"), ["app_id", "review_id"], start=last)
        tables.append_table(rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.REVIEWS]), root, "reviews")
    except Exception:
        finish = finish.withColumns({"status": F.lit("failed"), "reviews_collected": F.lit(0)})
        raise
    finally:
        tables.replace_table(ingest.update_by_key(tables.scan(spark, root, "ingestion_runs"), finish, "id"), root, "ingestion_runs")


def features_of(reviews: DataFrame, apps: DataFrame, processed_at: str) -> DataFrame:
    """The table of features of all reviews with text enough."""
    rows = reviews.where(F.length("text") >= LEAST_CHARS).join(apps.select("app_id", "app_name"), "app_id")
    rows = sentiment.with_labels(rows.withColumn("compound", scorers.compound(F.col("text"))))
    found = aspects.extract(F.col("text"))
    filled = py_strip(F.col("text")) != ""
    rows = rows.withColumns(
        {
            "vader_compound": F.when(filled, F.bround("compound", 4)), "textblob_subjectivity": scorers.subjectivity(F.col("text")), "textblob_polarity": scorers.polarity(F.col("text")),
            "spacy_aspects": found, "spacy_aspect_count": F.coalesce(F.size(found), F.lit(0)), "processed_at": F.lit(processed_at).cast("timestamp_ntz"),
        }
    )
    return schemas.add_missing_columns(rows, schemas.FEATURES).select(*[F.col(f.name).cast(f.dataType) for f in schemas.FEATURES])


def features_stage(spark: SparkSession, root: str, processed_at: str) -> None:
    """All eligible reviews are processed again; rows of the table are replaced whole."""
    fresh = features_of(tables.scan(spark, root, "reviews"), tables.scan(spark, root, "apps"), processed_at)
    stored = tables.scan_optional(spark, root, "features", schemas.FEATURES)
    tables.replace_table(ingest.upsert_replace(stored, fresh, "review_id"), root, "features")


def health_stage(spark: SparkSession, root: str) -> DataFrame:
    apps = tables.scan(spark, root, "apps")
    reviews = tables.scan(spark, root, "reviews").join(apps.select("app_id", "app_name"), "app_id")
    return health.report(reviews, tables.scan(spark, root, "ingestion_runs"), apps)


def backlog_of(features: DataFrame, reviews: DataFrame, as_of: str, least: int = priority.LEAST_MENTIONS) -> DataFrame:
    """Features and the dates of their reviews to the ranked backlog."""
    rows = features.where("spacy_aspects is not null").select("review_id", "app_name", "rating", F.col("combined_label").alias("label"), F.col("spacy_aspects").alias("aspects"))
    rows = rows.join(reviews.select("review_id", "date"), "review_id", "left")
    return priority.backlog(aspects.mentions(rows), as_of, least)


def retried(stage: Callable, *args, retries: int = RETRIES, pause_s: float = PAUSE_S, **kw):
    """Call a stage, again after a pause if it raises."""
    for k in range(retries + 1):
        try:
            return stage(*args, **kw)
        except Exception:
            if k == retries:
                raise
            time.sleep(pause_s)


def daily(spark: SparkSession, root: str, raw: DataFrame, started_at: str, completed_at: str, retries: int = RETRIES, pause_s: float = PAUSE_S) -> DataFrame:
    """Ingest, features, health: each after the one before has ended well. Gives the health report."""
    retried(ingest_stage, spark, root, raw, started_at, completed_at, retries=retries, pause_s=pause_s)
    retried(features_stage, spark, root, completed_at, retries=retries, pause_s=pause_s)
    return retried(health_stage, spark, root, retries=retries, pause_s=pause_s)
