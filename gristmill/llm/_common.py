"""Helpers that the operators share: the shared folder, cut lineage, bounded samples, text batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker works on at once; Spark bounds the Arrow batches themselves.
PART_BYTES = 8 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    A temporary one only where both are unset and all tasks run in the driver's process (tests); an error on a cluster.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gristmill-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_root(spark).rstrip('/')}/gristmill-{tag}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Cut lineage: write to the shared folder and read again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = path or shared_path(spark, tag)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(batch, texts, most: int = PART_BYTES):
    """Slices of a batch, without copies, with about `most` bytes of its column `texts`, or one longer text."""
    import numpy as np
    import pyarrow.compute as pc

    if len(texts) == 0:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = int(size[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, mod 4; fold 2 is held out of every fit."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4


def labelled_sample(labels: DataFrame, label: str, cap: int) -> DataFrame:
    """(doc_id, y) of at most about `cap` labelled rows outside the held-out fold, chosen by a hash of the id.

    Rows with a null id or label don't count; an id with several labels has its largest. The size has the bound
    `cap` (exact: a limit in hash order after the threshold), so the result may be broadcast.
    """
    own = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where("doc_id is not null and y is not null")
        .where(fold("doc_id") != 2)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    n = own.count()
    slot = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    if n > cap:
        own = own.where(slot < int((1 << 30) * (cap / n) * 1.05)).orderBy(slot, "doc_id").limit(cap)
    return own


def words_expr(text: Column | str) -> Column:
    """Words of ASCII white space, as an array; null text: empty."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def scratch(name: str) -> str:
    """A name that clashes with no column of the caller."""
    return f"__gristmill_{name}"


def utf8(col) -> list[bytes | None]:
    """A string column of an Arrow batch as bytes, without decoding."""
    import pyarrow as pa

    return col.cast(pa.large_binary()).to_pylist() if pa.types.is_large_string(col.type) else col.cast(pa.binary()).to_pylist()


def quiet_threads() -> None:
    for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(k, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
