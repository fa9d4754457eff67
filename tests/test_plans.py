"""Plan-shape checks: no Python evaluation anywhere, one scan per profile,
pushed-down projections, broadcast where a side is bounded."""

import pytest

import __spark_entry__ as E
from tablekit.operators.profile import numeric_profile
from tablekit.plans.catalog import all_oracle_sql
from tablekit.session import table


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(all_oracle_sql()))
def test_no_python_udf(spark, sf_small, key):
    p = _plan(E.queries()[key](spark, sf_small))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


def test_numeric_profile_single_scan_single_aggregate(spark, sf_small):
    """The exact profile runs its passes at once; the first of them has this plan."""
    p = _plan(numeric_profile(table(spark, sf_small, "lineitem"), approx=True))
    assert p.count("FileScan parquet") == 1
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint" in p
    assert "l_shipdate" not in p.split("ReadSchema:")[1].split("\n")[0]


def test_target_encoding_apply_broadcasts_statistics(spark, sf_small):
    p = _plan(E.queries()["target_encode_apply"](spark, sf_small))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_bm25_streams_postings_against_broadcast_query_terms(spark, sf_small):
    p = _plan(E.queries()["bm25_score"](spark, sf_small))
    assert "BroadcastHashJoin" in p


def test_topk_is_a_window_group_limit(spark, sf_small):
    p = _plan(E.queries()["retrieve_topk"](spark, sf_small))
    assert "WindowGroupLimit" in p
