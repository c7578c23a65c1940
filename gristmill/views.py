"""The driver's tables seen as the feedback domain: each view as a DataFrame and as the SQL of a common table expression.

Pure projections and joins with a small dimension; nothing is computed that a later operator should compute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Day that recency is measured from.
AS_OF = "2001-11-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """app_id, app_name, category: one for each nation."""
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    rows = table(spark, sf_dir, "nation").join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey"))  # a fixed table of five rows
    return rows.select(F.col("n_nationkey").alias("app_id"), F.col("n_name").alias("app_name"), F.col("r_name").alias("category"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews, with a made-up rating and text score."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("review_id"),
        (F.col("doc_id") % 25).cast("int").alias("app_id"),
        (1 + (F.col("doc_id") * 7 + F.col("n_chars")) % 5).cast("int").alias("rating"),
        "text", "lang",
        (F.col("n_chars") % 4).cast("int").alias("thumbs_up"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 365 as int))").alias("date"),
        (((F.col("doc_id") * 37) % 201 - 100).cast("double") / 100.0).alias("compound"),
    )


def named_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with the name of their app."""
    return reviews(spark, sf_dir).join(apps(spark, sf_dir).select("app_id", "app_name"), "app_id")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ingestion runs."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "in_progress").otherwise("success")
    seconds = F.expr("ts + make_dt_interval(0, 0, 0, value)")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 25).cast("int").alias("app_id"), F.col("ts").alias("started_at"),
        F.floor("value").cast("bigint").alias("reviews_collected"), status.alias("status"), F.when(status != "in_progress", seconds).alias("completed_at"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as mentions: one row for each review and aspect."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    rating = (1 + (F.col("l_partkey") + F.col("l_linenumber") + F.col("l_orderkey")) % 5).cast("int")
    label = F.when(rating <= 2, "negative").when(rating >= 4, "positive").otherwise("neutral")
    return rows.select(F.col("n_name").alias("app_name"), F.col("p_name").alias("aspect"), rating.alias("rating"), label.alias("label"), F.col("l_shipdate").alias("date"))


def raw_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a raw batch whose ids repeat, with scores out of range among them; seq is the place in the batch."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("reviewId"), (F.col("l_suppkey") % 25).cast("int").alias("app_id"), (F.col("l_quantity").cast("int") % 7).alias("score"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("content"), F.col("l_shipdate").cast("string").alias("at"),
        F.lit(None).cast("string").alias("reviewCreatedVersion"), F.when(F.col("l_linestatus") == "F", F.col("l_linenumber")).cast("int").alias("thumbsUpCount"), F.lit("").alias("replyContent"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag").alias("seq"),
    )


def known_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored reviews: the first line of each is known, for the app of its customer."""
    return table(spark, sf_dir, "orders").select(F.concat_ws("-", "o_orderkey", F.lit(1)).alias("review_id"), (F.col("o_custkey") % 25).cast("int").alias("app_id"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as source probes of a client: how much was asked for and how much came."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("probe"), F.col("o_orderkey").alias("run"), F.lit(500).cast("bigint").alias("requested"),
        (F.col("o_totalprice").cast("bigint") % 500).alias("returned"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("success").alias("status"),
    )


# ---- the same views as SQL

APPS = "apps AS (SELECT n_nationkey AS app_id, n_name AS app_name, r_name AS category FROM nation JOIN region ON n_regionkey = r_regionkey)"
REVIEWS = """reviews AS (SELECT doc_id AS review_id, CAST(doc_id % 25 AS INTEGER) AS app_id, CAST(1 + (doc_id * 7 + n_chars) % 5 AS INTEGER) AS rating, text, lang,
  CAST(n_chars % 4 AS INTEGER) AS thumbs_up, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 365 AS INTEGER)) AS date,
  CAST((doc_id * 37) % 201 - 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS compound FROM documents)"""
NAMED = f"{APPS}, {REVIEWS}, named AS (SELECT reviews.*, app_name FROM reviews JOIN apps USING (app_id))"
RUNS = """runs AS (SELECT event_id AS id, CAST(user_id % 25 AS INTEGER) AS app_id, ts AS started_at, CAST(floor(value) AS BIGINT) AS reviews_collected,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'in_progress' ELSE 'success' END AS status FROM events)"""
MENTIONS = """m0 AS (SELECT n_name AS app_name, p_name AS aspect, CAST(1 + (l_partkey + l_linenumber + l_orderkey) % 5 AS INTEGER) AS rating, l_shipdate AS date
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
mentions AS (SELECT *, CASE WHEN rating <= 2 THEN 'negative' WHEN rating >= 4 THEN 'positive' ELSE 'neutral' END AS label FROM m0)"""
RAW = """raw AS (SELECT l_orderkey || '-' || l_linenumber AS review_id, CAST(l_suppkey % 25 AS INTEGER) AS app_id, CAST(l_quantity AS INTEGER) % 7 AS rating,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag || l_linestatus END AS text, l_shipdate AS date, CASE WHEN l_linestatus = 'F' THEN CAST(l_linenumber AS INTEGER) ELSE 0 END AS thumbs_up,
  l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag FROM lineitem)"""
SEQ = "l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag"
KNOWN = "known AS (SELECT o_orderkey || '-1' AS review_id, CAST(o_custkey % 25 AS INTEGER) AS app_id FROM orders)"
RUN_LOG = """run_log AS (SELECT o_custkey AS probe, o_orderkey AS run, CAST(500 AS BIGINT) AS requested, CAST(trunc(o_totalprice) AS BIGINT) % 500 AS returned,
  CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'success' END AS status FROM orders)"""
LABELLED = f"""{NAMED}, signal AS (SELECT *, CASE WHEN rating <= 2 THEN 'negative' WHEN rating >= 4 THEN 'positive' ELSE 'neutral' END AS rating_signal,
  regexp_matches(coalesce(text, ''), '[^\\s]') AS filled, length(coalesce(text, '')) AS n FROM named),
blend AS (SELECT *, CASE WHEN n < 20 THEN CAST(0.9 AS DOUBLE) WHEN n < 100 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS combined_weight_rating,
  CASE WHEN n < 20 THEN CAST(0.9 AS DOUBLE) WHEN n < 100 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END * ((CAST(rating AS DOUBLE) - 3) / 2)
  + CASE WHEN n < 20 THEN CAST(0.1 AS DOUBLE) WHEN n < 100 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END * compound AS combined_score FROM signal),
labelled AS (SELECT *,
  CASE WHEN NOT filled THEN NULL WHEN rating <= 2 THEN 'negative' WHEN rating >= 4 THEN 'positive' WHEN compound >= CAST(0.1 AS DOUBLE) THEN 'positive'
       WHEN compound <= CAST(-0.1 AS DOUBLE) THEN 'negative' ELSE 'neutral' END AS vader_label,
  CASE WHEN NOT filled THEN NULL WHEN rating <= 2 OR rating >= 4 THEN 'rating' ELSE 'vader_text' END AS vader_method,
  CASE WHEN combined_score >= CAST(0.1 AS DOUBLE) THEN 'positive' WHEN combined_score <= CAST(-0.1 AS DOUBLE) THEN 'negative' ELSE 'neutral' END AS combined_label FROM blend)"""


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + "\n"
