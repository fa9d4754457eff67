"""Joins and scans that a query runs once, whatever its passes; tasks grow with the rows."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tablekit.operators import model as M
from tablekit.operators import profile as P
from tablekit.operators import validate as VA


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _joined(spark):
    a = spark.createDataFrame([(i, float(i), float(i * i % 7)) for i in range(40)], "k int, x double, z double")
    b = spark.createDataFrame([(i, 2.0 * i + 1) for i in range(40)], "k int, y double")
    return a.join(b, "k").select("x", "z", "y")


def test_collinear_pairs_are_no_aggregate_per_pair(spark):
    pairs = P.multicollinear_pairs(_joined(spark))
    assert "covar_pop" not in _plan(pairs)
    assert [tuple(r) for r in pairs.collect()] == [("x", "y", 1.0)]
    odd = spark.createDataFrame([(1.0, 1.0, None), (2.0, 1.0, None), (3.0, 1.0, 5.0)], "a double, b double, c double")
    assert P.multicollinear_pairs(odd).collect() == [] and P.multicollinear_pairs(odd.select("a")).collect() == []


def test_leakage_reads_the_joined_table_once(spark):
    found = VA.leakage_by_correlation(_joined(spark), "y")
    assert "SortMergeJoin" not in _plan(found) and "HashJoin" not in _plan(found)
    assert [(r.column_name, r.severity) for r in found.collect()] == [("x", "high_leakage_risk")]


@pytest.mark.parametrize("key", ["encode_and_log", "mandatory_drops"])
def test_view_is_joined_once(spark, sf_small, key):
    assert "orders.parquet" not in _plan(E.queries()[key](spark, sf_small))


def test_tasks_of_a_tree_learner_grow_with_the_rows(spark):
    df = spark.range(1000).coalesce(1)
    assert M.dealt(df, 100).rdd.getNumPartitions() == 10 and M.dealt(df, 100).count() == 1000
    assert M.dealt(df).rdd.getNumPartitions() == 1
    assert M.dealt(df, 100).agg(F.sum("id")).first()[0] == 499500
