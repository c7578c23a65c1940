"""Connected components of a large graph by alternating star steps over DataFrames.

Each round joins edges with the least neighbour of each node, which is aggregated before it is shuffled; the rounds
grow with the logarithm of the longest chain. Edges are cut from their lineage by a table in the shared folder after
each round and never come to the driver, only their count and a checksum do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._common import drop_path, materialize, shared_path


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour v of u is linked to the least of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these. Edges are (u, v) with v < u."""
    least = _least(edges)
    joined = edges.join(least, "u")
    to_least = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return to_least.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u long, v long) to (node, component): the least node that each node of an edge can reach.

    Loops and nulls are ignored, repeated edges count once; nodes without edges don't appear.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u != v").distinct()

    def state(df: DataFrame):
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return r[0], r[1]

    path = shared_path(spark, "edges")
    e = materialize(e, "edges", path)
    before = state(e)
    while before[0]:
        new = shared_path(spark, "edges")
        e = materialize(_small_star(_large_star(e)), "edges", new)
        now = state(e)
        drop_path(spark, path)
        path = new
        if now == before:
            break
        before = now
    top = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(top)
