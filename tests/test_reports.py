"""Sections of the validation report and the full profile on a small table with every finding."""

import pytest

from tablekit.operators import profile as P
from tablekit.operators import validate as VA


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, "same", None, float(i % 7), float(2 ** (i % 12))) for i in range(40)]
    rows += [rows[0]] * 2                                                   # copies of a row
    return spark.createDataFrame(rows, "row_id int, fixed string, gone double, x double, y double").repartition(3)


def test_validation_report_sections(table):
    out = VA.validation_report(table, "y", table.drop("y", "x")).collect()
    got = {}
    for r in out:
        got.setdefault(r["section"], []).append((r["column_name"], r["risk"], r["detail"]))
    assert {(risk, n) for _, risk, n in got["summary"]} == {("n_rows_train", "42"), ("n_rows_test", "42"), ("n_features", "4")}
    assert {(c, k) for c, k, _ in got["kinds"]} == {("row_id", "numeric"), ("fixed", "categorical"), ("gone", "numeric"), ("x", "numeric")}
    # a column of missing values is constant as well: the first reason stays
    assert {(c, r) for c, r, _ in got["drop"]} == {("row_id", "id_like_column"), ("gone", "all_missing"), ("fixed", "constant_column")}
    assert {d for _, _, d in got["actions"]} == {
        "drop 'row_id' from modeling features (ID-like)", "drop 'gone' (100% NaN)", "drop constant column 'fixed'",
        "drop constant column 'gone'", "deduplicate 2 duplicate rows"} | (
        {"consider log-transform for target"} if any(r == "high_skew_target" for _, r, _ in got["target"]) else set())
    assert got["schema"] == [("x", "missing_in_test", None)]
    assert got["verdict"] == [(None, "can_proceed", "true")]


def test_validation_report_without_test_or_rows(table):
    out = VA.validation_report(table.limit(0), "y").collect()
    assert [r["detail"] for r in out if r["section"] == "verdict"] == ["false"]
    assert {(r["risk"], r["detail"]) for r in out if r["section"] == "summary"} == {("n_rows_train", "0"), ("n_features", "4")}


def test_full_profile_has_shape_collinear_pairs_and_percentiles(table):
    df = table.withColumn("twice", table["x"] * 2)
    out = {(r["section"], r["column_name"], r["stat"], r["label"]): r["value"] for r in P.full_profile(df, "y").collect()}
    assert out["collinear", "x", "corr", "twice"] == 1.0
    assert out["shape", None, "total_rows", None] == 42 and out["shape", None, "complete_rows", None] == 0
    assert out["shape", None, "columns", None] == 6
    y = df.select("y").toPandas()["y"]
    assert [out["target", "y", f"p{p}", None] for p in (25, 50, 75, 90, 95)] == pytest.approx([round(y.quantile(p / 100), 2) for p in (25, 50, 75, 90, 95)])
