"""The batch ingest over a stream of raw files: the same operators for each micro-batch. An addition of our own; batches alone match the reference behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill import schemas
from gristmill.operators import ingest
from gristmill.sources import tables


def raw_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schemas.RAW).option("maxFilesPerTrigger", files).json(path)


def merge_batch(batch: DataFrame, root: str, lang: str, country: str, scraped_at: str) -> None:
    """Add what one batch has that the table of reviews lacks; a batch that runs again adds nothing."""
    spark = batch.sparkSession
    stored = tables.scan_optional(spark, root, "reviews", schemas.REVIEWS)
    numbered = batch.withColumn("seq", F.monotonically_increasing_id()) if "seq" not in batch.columns else batch
    rows = ingest.new_reviews(ingest.coerce(numbered, lang, country, scraped_at), stored).drop("seq")
    rows = schemas.add_missing_columns(rows, schemas.REVIEWS).select(*[F.col(f.name).cast(f.dataType) for f in schemas.REVIEWS])
    tables.append_table(rows, root, "reviews")


def start(stream: DataFrame, root: str, checkpoint: str, lang: str = "en", country: str = "us", scraped_at: str = "1970-01-01 00:00:00", once: bool = True) -> StreamingQuery:
    """Run the ingest until the files there are read (once) or until it's stopped."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: merge_batch(batch, root, lang, country, scraped_at))
    return (writer.trigger(availableNow=True) if once else writer).start()


def label_trend(labelled: DataFrame, late: str = "7 days", width: str = "7 days") -> DataFrame:
    """Counts by label over tumbling windows of a stream (review_id, date timestamp, combined_label), each review once."""
    rows = labelled.withWatermark("date", late).dropDuplicatesWithinWatermark(["review_id"])
    return rows.groupBy(F.window("date", width), "combined_label").agg(F.count(F.lit(1)).alias("n"))
