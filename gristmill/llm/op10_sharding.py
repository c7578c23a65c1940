"""Sharding by a permutation-filled lookup table: shards take turns claiming the next free slot of their own preference
order in a prime-sized table; keys are placed by one hash and one lookup. DataFrame functions only.

The table has a fixed, documented size (TABLE_SIZE entries of a few bytes, whatever the data), so it is broadcast.
Placement is one map-side join: no shuffle, no state, and no key or bucket meets another row, so a key with a third
of all rows costs nothing more. A table of at least 100 slots a shard keeps shards within about 1 % of each other;
adding or removing one moves little beyond the slots that it gains or loses.

Defined results: a null key is placed like an empty string; repeated keys share a shard; an empty table gives no
rows; other columns are kept by `place` (which adds slot and shard) and ignored by the query.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm._common import scratch

TABLE_SIZE = 4_099
SHARDS = 32


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and step of a shard's permutation of the slots."""
    h = hashlib.md5(name.encode()).hexdigest()
    return int(h[:8], 16) % size, int(h[8:16], 16) % (size - 1) + 1


def lookup_table(names: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The number of the shard that holds each slot. `size` is prime, so that each step visits every slot."""
    if not names or len(set(names)) < len(names) or size < len(names) or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("distinct shard names and a prime size of at least their number are needed")
    at = [preference(n, size) for n in names]
    slot, table = [o for o, _ in at], [-1] * size
    for turn in range(size):
        i = turn % len(names)
        while table[slot[i]] >= 0:
            slot[i] = (slot[i] + at[i][1]) % size
        table[slot[i]] = i
    return table


def key_slot(key: Column, size: int = TABLE_SIZE) -> Column:
    h = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(h, 1, 15), 16, 10).cast("long") % size).cast("int")


def table_frame(spark: SparkSession, table: list[int]) -> DataFrame:
    """(slot, shard) of a table, as a frame of len(table) rows."""
    return spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, table))), ",")).alias("slot", "shard")).withColumn("shard", F.col("shard").cast("int"))


def place(df: DataFrame, key: Column, names: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The rows of df with `slot` and `shard` (the place of the shard in names)."""
    s, n = scratch("slot"), scratch("shard")
    table = table_frame(df.sparkSession, lookup_table(names, size)).select(F.col("slot").alias(s), F.col("shard").alias(n))
    out = df.withColumn("slot", key_slot(key, size))
    return out.join(F.broadcast(table), F.col("slot") == F.col(s)).withColumn("shard", F.col(n)).drop(s, n)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, F.col("doc_id"), [f"shard-{i}" for i in range(SHARDS)])


ORACLE = f"""
WITH RECURSIVE p AS (
  SELECT list(CAST('0x' || substr(md5('shard-' || i), 1, 8) AS BIGINT) % {TABLE_SIZE} ORDER BY i) AS o,
         list(CAST('0x' || substr(md5('shard-' || i), 9, 8) AS BIGINT) % {TABLE_SIZE - 1} + 1 ORDER BY i) AS s
  FROM range({SHARDS}) t(i)),
fill(turn, tab) AS (
  SELECT 0, list_transform(range({TABLE_SIZE}), lambda x: -1)
  UNION ALL
  SELECT turn + 1, list_transform(tab, lambda x, k: CASE WHEN k = slot + 1 THEN turn % {SHARDS} ELSE x END)
  FROM (SELECT turn, tab,
          (o[turn % {SHARDS} + 1] + s[turn % {SHARDS} + 1] * list_filter(range({TABLE_SIZE}),
             lambda j: tab[(o[turn % {SHARDS} + 1] + s[turn % {SHARDS} + 1] * j) % {TABLE_SIZE} + 1] = -1)[1]) % {TABLE_SIZE} AS slot
        FROM fill, p WHERE turn < {TABLE_SIZE})),
t AS (SELECT tab FROM fill WHERE turn = {TABLE_SIZE}),
d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {TABLE_SIZE} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, CAST(tab[slot + 1] AS INTEGER) AS shard FROM d, t
"""
