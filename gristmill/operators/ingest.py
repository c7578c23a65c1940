"""Incremental, idempotent ingest of raw review batches."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coerce(raw: DataFrame, lang: str, country: str, scraped_at: str, run_id: Column | None = None) -> DataFrame:
    """Raw records to review rows: empty text and reply become null, no votes 0, a missing score 0. (I8)

    raw: app_id, reviewId, score, content, at, reviewCreatedVersion, thumbsUpCount, replyContent and seq, the place in the batch.
    """
    blank = F.lit("")
    return raw.select(
        F.col("reviewId").alias("review_id"), "app_id", (run_id if run_id is not None else F.lit(None).cast("long")).alias("ingestion_run_id"),
        F.coalesce("score", F.lit(0)).cast("int").alias("rating"), F.nullif("content", blank).alias("text"), F.try_to_timestamp("at").cast("timestamp_ntz").alias("date"),
        F.col("reviewCreatedVersion").alias("app_version"), F.coalesce("thumbsUpCount", F.lit(0)).cast("int").alias("thumbs_up"), F.nullif("replyContent", blank).alias("reply"),
        F.lit(lang).alias("lang"), F.lit(country).alias("country"), F.lit(scraped_at).cast("timestamp_ntz").alias("scraped_at"), "seq",
    )


def first_of_batch(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The first occurrence of each key."""
    w = Window.partitionBy(*keys).orderBy(seq)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def unknown(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't stored."""
    return rows.join(existing.select(*keys).distinct(), keys, "left_anti")


def checked(rows: DataFrame, apps: DataFrame | None = None) -> DataFrame:
    """Rows that the stored table's constraints allow."""
    ok = rows.where(F.col("rating").between(1, 5) & F.col("review_id").isNotNull())
    return ok.join(apps.select("app_id").distinct(), "app_id", "left_semi") if apps is not None else ok


def new_reviews(batch: DataFrame, existing: DataFrame, apps: DataFrame | None = None) -> DataFrame:
    """What a batch adds: known ids of the app are skipped, the first of a batch counts, ids are unique over all apps."""
    attempted = attempts(batch, existing)
    return checked(unknown(first_of_batch(checked(attempted, apps), ["review_id"]), existing, ["review_id"]))


def attempts(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows that an insert is tried for: not known for this app, first of their app in the batch."""
    return first_of_batch(unknown(batch, existing, ["app_id", "review_id"]), ["app_id", "review_id"])


def ingest_counts(batch: DataFrame, existing: DataFrame, apps: DataFrame | None = None) -> DataFrame:
    """Per app: rows fetched, attempted, stored and skipped. `attempted` counts rows that constraints then drop."""
    n = lambda df, name: df.groupBy("app_id").agg(F.count(F.lit(1)).alias(name))
    out = n(batch, "fetched").join(n(attempts(batch, existing), "attempted"), "app_id", "left").join(n(new_reviews(batch, existing, apps), "stored"), "app_id", "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("attempted", "stored")})
    return out.withColumn("skipped", F.col("fetched") - F.col("attempted"))


def finished_runs(apps: DataFrame, counts: DataFrame, started_at: str, completed_at: str) -> DataFrame:
    """A run for each app: failed if nothing was fetched."""
    rows = apps.select("app_id").join(counts, "app_id", "left")
    status = F.when(F.coalesce("fetched", F.lit(0)) == 0, "failed").otherwise("success")
    return rows.select(
        "app_id", F.lit(started_at).cast("timestamp_ntz").alias("started_at"), F.lit(completed_at).cast("timestamp_ntz").alias("completed_at"),
        F.coalesce("attempted", F.lit(0)).cast("int").alias("reviews_collected"), status.alias("status"),
    )


def settled(df: DataFrame) -> DataFrame:
    """The rows computed once, for plans that read them twice and must see the same partitions.

    A reliable checkpoint where the context has a checkpoint folder; else kept with the session (tests).
    """
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist(StorageLevel.MEMORY_AND_DISK)


def with_ids(rows: DataFrame, order: list[str], start: int = 0, name: str = "id", ranges: int = 256) -> DataFrame:
    """Dense ids from start + 1 in the given order: counts of ranges first, then numbers within each."""
    w = Window.partitionBy("__part").orderBy(*order)
    parts = settled(rows.repartitionByRange(ranges, *order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__c"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    numbered = parts.withColumn("__n", F.row_number().over(w))
    return numbered.join(F.broadcast(before), "__part").withColumn(name, F.lit(start) + F.col("__before") + F.col("__n")).drop("__part", "__n", "__before")  # at most `ranges` rows


def _one_of_batch(rows: DataFrame, keys: list[str], seq: str | None, last: bool) -> DataFrame:
    """The first or last row of each key in the order of column `seq`, without it; of equal places the least by value."""
    values = [c for c, kind in rows.dtypes if c != seq and "map<" not in kind and "variant" not in kind]
    place = [] if seq is None else [F.col(seq).desc() if last else F.col(seq)]
    w = Window.partitionBy(*keys).orderBy(*place, *values)
    one = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return one if seq is None else one.drop(seq)


def upsert_ignore(stored: DataFrame, rows: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """The stored row wins, else the first of the batch in the order of `seq`, which isn't stored. Null keys are new."""
    return stored.unionByName(_one_of_batch(rows, keys, seq, last=False).join(stored.select(*keys), keys, "left_anti"))


def upsert_replace(stored: DataFrame, rows: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """The last new row of a key replaces the whole stored row; columns that it lacks become null."""
    new = _one_of_batch(rows, [key], seq, last=True)
    return stored.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def update_by_key(stored: DataFrame, changes: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """Stored rows with the columns of the last change of their key, nulls included; other rows are as they were.

    Columns that aren't stored yet are added, null without a change.
    """
    own = _one_of_batch(changes, [key], seq, last=True)
    names = [c for c in own.columns if c != key]
    out = stored.join(own.select(key, F.lit(True).alias("__matched"), *[F.col(c).alias(f"__{c}") for c in names]), key, "left")
    new = {c: F.when(F.col("__matched"), F.col(f"__{c}")).otherwise(F.col(c)) if c in stored.columns else F.col(f"__{c}") for c in names}
    return out.select(*[new.pop(c).alias(c) if c in new else F.col(c) for c in stored.columns], *[v.alias(c) for c, v in new.items()])


def summary(reviews: DataFrame, runs: DataFrame, apps: DataFrame, last: int = 10) -> dict[str, DataFrame]:
    """Totals, counts per app, the last runs."""
    from gristmill.operators.health import latest_runs, reviews_per_app

    return {"total": reviews.agg(F.count(F.lit(1)).alias("n")), "per_app": reviews_per_app(reviews), "runs": latest_runs(runs, apps, last)}
