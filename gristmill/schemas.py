"""Declared schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    fields = []
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "time": T.TimestampNTZType(), "floats": T.ArrayType(T.FloatType()), "strings": T.ArrayType(T.StringType())}
    for part in ddl.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, kinds[kind]))
    return T.StructType(fields)


APPS = _schema("app_id string, app_name string, category string, created_at time")
RUNS = _schema("id long, app_id string, started_at time, completed_at time, reviews_collected int, status string")
RAW = _schema("app_id string, reviewId string, score int, content string, at string, reviewCreatedVersion string, thumbsUpCount int, replyContent string")
REVIEWS = _schema("id long, review_id string, app_id string, ingestion_run_id long, rating int, text string, date time, app_version string, thumbs_up int, reply string, lang string, country string, scraped_at time")
FEATURES = _schema(
    "review_id string, app_id string, app_name string, rating int, text string, vader_compound double, vader_label string, vader_method string, llm_sentiment_label string, "
    "llm_sentiment_confidence double, textblob_subjectivity double, textblob_polarity double, llm_subjectivity double, llm_subjectivity_reasoning string, spacy_aspects strings, "
    "spacy_aspect_count int, llm_aspects strings, llm_aspect_count int, combined_label string, combined_score double, combined_weight_rating double, embedding floats, tfidf_embedding floats, processed_at time"
)
VOTE_COLUMNS = _schema("final_label string, label_confidence double, label_source string")
PRIORITY = _schema(
    "rank int, app_name string, aspect string, mention_count long, negative_count long, positive_count long, negative_rate double, avg_rating double, recency_score_raw double, "
    "sentiment_norm double, volume_norm double, recency_norm double, priority_score double"
)
RUN_STATES = ("failed", "in_progress", "success")
TABLES = {"apps": APPS, "ingestion_runs": RUNS, "reviews": REVIEWS, "features": FEATURES}


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Create the tables that don't exist yet, as Parquet."""
    for name, schema in TABLES.items():
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def add_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema that df lacks, as nulls of their type."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns})
