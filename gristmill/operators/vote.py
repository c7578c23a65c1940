"""Conflicting labels settled by a majority of three."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import preview
from gristmill.operators.ingest import update_by_key

AMBIGUOUS = "ambiguous"


def majority(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """(label, confidence): two equal labels win; nulls don't vote."""
    valid = sum((x.isNotNull().cast("int") for x in (a, b, c)), F.lit(0))
    winner = F.when(a == b, a).when(a == c, a).when(b == c, b)
    top = F.when((a == b) & (b == c), 3).otherwise(2)
    return F.coalesce(winner, F.lit(AMBIGUOUS)), F.when(winner.isNotNull(), F.bround(top / valid, 2)).otherwise(0.0)


def conflicts(labelled: DataFrame) -> DataFrame:
    """Rows to settle: text label and blend differ, or three stars."""
    return labelled.where((F.col("vader_label") != F.col("combined_label")) | (F.col("rating") == 3))


def reuse_or_score(known: Column, scored: Column, confidence: Column) -> tuple[Column, Column]:
    """A known model label is kept, without a confidence; others are scored. (P20)"""
    return F.coalesce(known, scored), F.when(known.isNull(), confidence)


def settle(labelled: DataFrame, model_label: Column, model_confidence: Column) -> DataFrame:
    """One row for each conflict with the vote and its source. (V4)"""
    rows = conflicts(labelled).withColumn("llm_label", model_label).withColumn("llm_confidence", model_confidence)
    final, sure = majority(F.col("rating_signal"), F.col("vader_label"), F.col("llm_label"))
    rows = rows.withColumn("final_label", final).withColumn("label_confidence", sure)
    source = F.when(F.col("final_label") == AMBIGUOUS, "none").otherwise(F.col("final_label"))
    return rows.select(
        "review_id", "app_name", "rating", preview(F.col("text"), 100).alias("text_preview"), "rating_signal", "vader_label", "llm_label",
        "llm_confidence", "final_label", "label_confidence", source.alias("label_source"), "combined_score",
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Conflicts before plain three-star rows, then by strength."""
    first = F.when(F.col("vader_label") != F.col("combined_label"), 0).otherwise(1)
    return rows.orderBy(first, F.abs("combined_score").desc_nulls_last(), "review_id")


def write_back(features: DataFrame, votes: DataFrame) -> DataFrame:
    """Vote columns of the rows voted on, nulls included; others keep theirs."""
    return update_by_key(features, votes.select("review_id", "final_label", "label_confidence", "label_source"), "review_id")


def summary(votes: DataFrame) -> DataFrame:
    """Label and source counts as (kind, value, n)."""
    count = lambda c, kind: votes.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    return count("final_label", "label").unionByName(count("label_source", "source"))


def ambiguous_samples(votes: DataFrame, labelled: DataFrame, n: int = 3) -> DataFrame:
    """The first `n` ambiguous rows in the order of conflicts."""
    rows = votes.where(F.col("final_label") == AMBIGUOUS).join(labelled.select("review_id", "combined_label"), "review_id")
    return in_order(rows).limit(n).select("review_id", "app_name", "rating", "vader_label", "llm_label", "text_preview")
