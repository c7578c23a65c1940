"""Plans keep to scans of the columns and rows that are needed, and to built-in operators."""

import re

import pytest

from gristmill.plans import registry

#: Queries that call a model, and so Python workers or jobs of their own.
MODELS = {k for k in registry.QUERIES if re.match(r"v15_|t7_|v19_v20|v22_|v23_", k)}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - MODELS))
def test_no_python_and_no_product(spark, sf_dir, name):
    plan = plan_of(registry.QUERIES[name](spark, sf_dir))
    assert not re.search(r"CartesianProduct|BatchEvalPython|ArrowEvalPython|MapInPandas|PythonUDF", plan)


def test_backlog_reads_five_columns_and_aggregates_before_it_shuffles(spark, sf_dir):
    plan = plan_of(registry.QUERIES["v11_issue_backlog"](spark, sf_dir))
    scans = [s for s in re.findall(r"ReadSchema: struct<([^>]*)", plan) if "l_partkey" in s]
    columns = {c for s in scans for c in re.findall(r"\bl_\w+(?=:)", s)}
    assert columns == {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"}, scans
    assert "partial_count" in plan


def test_filters_reach_the_scan(spark, sf_dir):
    assert "GreaterThan(l_shipdate" in plan_of(registry.QUERIES["f19_recent"](spark, sf_dir))
    assert "IsNotNull(lang)" in plan_of(registry.QUERIES["j3_p3_features_with_dates"](spark, sf_dir))


@pytest.mark.parametrize("name", ["a3_date_range", "a5_rating_histogram", "a2_reviews_per_app", "v31_disagreement"])
def test_texts_are_read_only_where_needed(spark, sf_dir, name):
    plan = plan_of(registry.QUERIES[name](spark, sf_dir))
    assert ("text" in "".join(re.findall(r"ReadSchema: struct<([^>]*)>", plan))) == name.startswith("v31")
