"""Where tables come from and go to: Parquet folders, CSV, JDBC, raw JSON batches, text reports, models."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill import schemas

log = logging.getLogger(__name__)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its own file system, which may be one that only Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its declared schema where it has one."""
    reader = spark.read.schema(schemas.TABLES[name]) if name in schemas.TABLES else spark.read
    return reader.parquet(f"{root.rstrip('/')}/{name}.parquet")


def scan_optional(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """A table that need not be there: empty with the schema if it isn't; other errors are raised."""
    path = f"{root.rstrip('/')}/{name}.parquet"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else schemas.empty(spark, schema)


def scan_jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A query at another database; partition: (column, low, high, parts) reads it in parallel. (S3)"""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q").options(**options)
    if partition:
        column, low, high, parts = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def choose(spark: SparkSession, root: str, name: str, url: str | None = None, **options: str) -> DataFrame:
    """The remote table if a url is configured and its database answers, else the stored one. (S3)"""
    if url:
        try:
            return scan_jdbc(spark, url, f"SELECT * FROM {name}", **options)
        except (PySparkException, Py4JJavaError) as why:
            log.warning("no table %s at the configured database, reading the stored one: %s", name, str(why).split("\n")[0])
    return scan(spark, root, name)


def read_or_empty(spark: SparkSession, read: Callable[[], DataFrame], schema: T.StructType) -> DataFrame:
    """What `read` gives; an empty table with the schema if it fails for any reason, with a warning.

    Spark reads when rows are asked for, so only errors of planning are seen here: missing tables, columns, databases.
    """
    try:
        return read()
    except (PySparkException, Py4JJavaError, OSError) as why:
        log.warning("read as empty: %s", str(why).split("\n")[0])
        return schemas.empty(spark, schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(S5)"""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, quote='"', escape='"')


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder of CSV files with a header each."""
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"')


def vector_preview(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """Vectors as text of their first n components; null stays null."""
    shown = lambda c: F.concat(F.array_join(F.transform(F.slice(c, 1, n), lambda v: F.format_string("%.4f", v.cast("double"))), ", "), F.lit("..."))
    return df.withColumns({c: shown(c) for c in columns})


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw review records as JSON lines, with their place in the file."""
    rows = spark.read.schema(schemas.RAW).json(path)
    return rows.withColumn("seq", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def replace_table(df: DataFrame, root: str, name: str) -> None:
    """Write a table anew beside the old one, then take its place: df may read the old one."""
    spark = df.sparkSession
    new, final, old = (f"{root.rstrip('/')}/{name}.parquet{x}" for x in (".new", "", ".old"))
    df.write.mode("overwrite").parquet(new)
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    fs = path(final).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(old), True)
    if fs.exists(path(final)):
        fs.rename(path(final), path(old))
    fs.rename(path(new), path(final))
    fs.delete(path(old), True)
    spark.catalog.refreshByPath(final)


def append_table(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("append").parquet(f"{root.rstrip('/')}/{name}.parquet")


def written_once(df: DataFrame) -> DataFrame:
    """The rows computed once, for plans that read them many times.

    A table in the folder of checkpoints, removed when the driver's JVM ends; kept with the session where there is none (tests).
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{root.rstrip('/')}/gristmill-once-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small report as one file in any file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def save_model(model: PipelineModel, path: str) -> None:
    """(S14)"""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
