"""A corpus pipeline of five stages over `documents`: what each stage decides takes effect on the rows of the next.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents.

Defined results, in all stages: null and empty texts fail the base rules and so end at the second stage; texts of any
length are judged, compared, mixed and encoded whole; repeated rows count one by one until near_dedup keeps one of them;
a null doc_id is judged like any other, is kept by near_dedup and is mixed within its source; of ties the least doc_id,
then a hash of the row decides; an empty table gives no rows at any stage; other columns, whatever their names, are kept
by all stages but the last, which has its own columns alone.
"""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import op2_quality, op3_mixing, op7_simhash, op8_rules, op9_bpe
from gristmill.llm._common import shared_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees score under 0.7 go."""
    return op2_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go.

    The list is learned from labelled rows of all documents: those that the stage before kept have hardly a bad one.
    Where sf_dir has no documents (docs came from elsewhere) it is learned from the rows of docs, with a warning.
    """
    try:
        every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"{sf_dir} has no documents.parquet: rules are learned from the rows given", stacklevel=2)
        every = docs
    return op8_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn_from=every)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the least doc_id stays."""
    return op7_simhash.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one in which a source's budget ends is cut there."""
    return op3_mixing.mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return op9_bpe.encode_decode(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: A learned model and fingerprints of a hash that DuckDB lacks can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
