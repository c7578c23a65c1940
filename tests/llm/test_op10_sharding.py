"""Placement against SQL, balance, little movement, edge rows."""

from collections import Counter

import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from gristmill.llm import op10_sharding as op

NAMES = [f"shard-{i}" for i in range(8)]


def test_query_equals_sql(spark, sf_dir):
    assert_same(op.query(spark, sf_dir), connect(sf_dir), op.ORACLE)


def test_table_is_balanced_and_stable():
    table = op.lookup_table(NAMES, 1_009)
    n = Counter(table)
    assert set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1
    fewer = op.lookup_table(NAMES[:-1], 1_009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 7)
    assert moved < 0.25 * 1_009 and op.lookup_table(NAMES[:1], 7) == [0] * 7


@pytest.mark.parametrize(("names", "size"), [([], 7), (["a", "a"], 7), (["a", "b"], 8), (["a", "b", "c"], 2)])
def test_bad_tables(names, size):
    with pytest.raises(ValueError):
        op.lookup_table(names, size)


def test_edges(spark):
    df = spark.createDataFrame([(None, 1), ("", 1), ("k", 1), ("k", 2), ("é" * 100_000, 1)], "key string, tab int")
    got = {(r.key, r.tab): r.shard for r in op.place(df, F.col("key"), NAMES, 1_009).collect()}
    assert got[(None, 1)] == got[("", 1)] and got[("k", 1)] == got[("k", 2)] and len(got) == 5
    assert op.place(df.limit(0), F.col("key"), NAMES, 1_009).columns == ["key", "tab", "slot", "shard"]
    assert op.place(df.limit(0), F.col("key"), NAMES, 1_009).count() == 0
    clash = spark.createDataFrame([("k", 5, 6)], "key string, slot int, shard int")
    assert op.place(clash, F.col("key"), NAMES, 1_009).columns == ["key", "slot", "shard"]


def test_plan_has_no_shuffle(spark, sf_dir):
    plan = op.query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Python" not in plan
