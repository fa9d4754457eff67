"""Unit and property tests on small literal frames, checked against independent
pandas / numpy computations."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablekit.functions import stats as S
from tablekit.functions.joins import dense_index, group_positions
from tablekit.operators import extras as X
from tablekit.operators import features as FE
from tablekit.operators import profile as P
from tablekit.operators import retrieve as R
from tablekit.operators import scan as G
from tablekit.operators import validate as VA


def test_sample_moments_match_pandas(spark):
    rng = np.random.default_rng(1)
    x = rng.gamma(2.0, 3.0, 200)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    r = df.agg(S.sample_skew(F.col("x")).alias("s"), S.sample_kurtosis(F.col("x")).alias("k")).first()
    assert r["s"] == pytest.approx(pd.Series(x).skew(), rel=1e-9)
    assert r["k"] == pytest.approx(pd.Series(x).kurt(), rel=1e-9)


def test_constant_column_moments_and_corr(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(10)], "c double, y double")
    r = df.agg(S.sample_skew(F.col("c")).alias("s"), S.sample_kurtosis(F.col("c")).alias("k"),
               S.safe_corr(F.col("c"), F.col("y")).alias("r")).first()
    assert r["s"] == 0.0 and r["k"] == 0.0 and r["r"] is None


def test_fold_hash_matches_duckdb(spark, duck):
    keys = ["a", "b", "123", "row-7"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r["k"]: r["h"] for r in df.select("k", S.fold_hash("k").alias("h")).collect()}
    for k in keys:
        want = duck.execute(f"select cast('0x' || substr(md5('{k}'), 1, 8) as bigint)").fetchall()[0][0]
        assert got[k] == want


def test_missing_report_counts_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b"), (2.0, "c")],
                               "x double, s string")
    rows = {r["column_name"]: r for r in P.missing_report(df).collect()}
    assert rows["x"]["missing_count"] == 2 and rows["x"]["missing_pct"] == 50.0
    assert rows["s"]["missing_count"] == 1
    assert P.complete_row_count(df).first()["complete_rows"] == 2


def test_target_encode_oof_equals_naive_loop(spark):
    rng = np.random.default_rng(7)
    n = 300
    pdf = pd.DataFrame({"key": [f"k{i}" for i in range(n)],
                        "cat": rng.choice(["a", "b", "c", None], n),
                        "y": rng.normal(10, 3, n)})
    df = spark.createDataFrame(pdf)
    out = FE.target_encode_oof(df, "cat", "y", "key", k=5).toPandas().set_index("key")
    folds = df.select("key", S.fold_of(F.concat(F.lit("cv-"), F.col("key")), 5).alias("f")) \
        .toPandas().set_index("key")["f"]
    gm = pdf["y"].mean()
    cat = pdf["cat"].astype(object).where(pdf["cat"].notna(), "nan")
    for i, row in pdf.iterrows():
        f = folds[row["key"]]
        other = pdf[(folds[pdf["key"]].values != f) & (cat.values == cat[i])]
        want = (other["y"].sum() + 20 * gm) / (len(other) + 20)
        assert out.loc[row["key"], "cat_te"] == pytest.approx(want, rel=1e-9)


def test_mode_impute_ties_take_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    out = [r["s"] for r in FE.mode_impute(df, ["s"]).collect()]
    assert out.count("a") == 3


def test_ordinal_unseen_is_minus_one(spark):
    train = spark.createDataFrame([("x",), ("y",), ("z",)], "c string")
    test = spark.createDataFrame([("y",), ("q",)], "c string")
    got = {r["c"]: r["c_code"] for r in FE.ordinal_encode(test, ["c"], fit_df=train, suffix="_code").collect()}
    assert got == {"y": 1, "q": -1}


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (400.0,), (10.0,)], "p double")
    got = [r["p"] for r in FE.clip_range(df, "p").collect()]
    assert got == [None, 0.0, 365.0, 10.0]


def test_dense_index_and_group_positions(spark):
    df = spark.range(0, 500).withColumn("g", (F.col("id") % 3).cast("int"))
    idx = sorted(r["idx"] for r in dense_index(df, ["id"]).collect())
    assert idx == list(range(500))
    pos = group_positions(df, ["g"], ["id"], "p").toPandas()
    for g, part in pos.groupby("g"):
        assert sorted(part["p"]) == list(range(len(part)))
        assert list(part.sort_values("id")["p"]) == list(range(len(part)))


def test_rank_in_group_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": range(200), "g": rng.choice(["a", "b"], 200),
                        "v": rng.integers(0, 20, 200).astype(float)})
    out = X.rank_in_group(spark.createDataFrame(pdf), "g", "v", "k").toPandas().set_index("k")
    want = pdf.groupby("g")["v"].rank(method="min")
    assert (out.loc[pdf["k"], "rank"].values == want.values).all()


def test_ridge_equals_closed_form(spark):
    from tablekit.operators.model import assemble, fit_ridge
    rng = np.random.default_rng(5)
    X_ = rng.normal(size=(200, 3))
    y = X_ @ np.array([1.0, -2.0, 0.5]) + 3 + rng.normal(0, 0.1, 200)
    pdf = pd.DataFrame(X_, columns=["a", "b", "c"]).assign(y=y)
    m = fit_ridge(assemble(spark.createDataFrame(pdf), ["a", "b", "c"]), "y", alpha=10.0).models[0]
    Xc, yc = X_ - X_.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + 10.0 * np.eye(3), Xc.T @ yc)
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-6)


def _naive_bm25(docs, query):
    toks = [re.findall(r"[a-z0-9_]+", d.lower()) for d in docs]
    n = len(toks)
    avg = sum(map(len, toks)) / n
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    eps = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: (eps if v < 0 else v) for w, v in idf.items()}
    out = []
    for t in toks:
        s = 0.0
        for q in re.findall(r"[a-z0-9_]+", query.lower()):
            f = t.count(q)
            s += idf.get(q, 0) * f * 2.5 / (f + 1.5 * (1 - 0.75 + 0.75 * len(t) / avg))
        out.append(s)
    return out


DOCS = ["the cat sat on the mat", "a dog and a cat", "spark joins at scale",
        "the the the", "Cat naps; CAT eats", ""]


def test_bm25_matches_naive(spark):
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(DOCS)], "chunk_id long, text string")
    q = spark.createDataFrame([(0, "cat the cat")], "query_id long, text string")
    got = {r["chunk_id"]: r["bm25"] for r in R.bm25_score(R.bm25_index(chunks), q).collect()}
    want = _naive_bm25(DOCS, "cat the cat")
    for i, w in enumerate(want):
        assert got.get(i, 0.0) == pytest.approx(w, abs=1e-9)


def test_tfidf_cosine_bounds(spark):
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(DOCS)], "chunk_id long, text string")
    q = spark.createDataFrame([(0, "cat sat"), (1, "spark at scale")], "query_id long, text string")
    vals = [r["tfidf"] for r in R.tfidf_cosine(R.tfidf_index(chunks), q).collect()]
    assert vals and all(-1e-12 <= v <= 1 + 1e-12 for v in vals)


def test_hybrid_top_k_positive_and_bounded(spark):
    chunks = spark.createDataFrame([(i, t, "s", ["x"]) for i, t in enumerate(DOCS)],
                                   "chunk_id long, text string, source string, tags array<string>")
    q = spark.createDataFrame([(0, "cat")], "query_id long, text string")
    res = R.Retriever.build(chunks).retrieve(q, k=2).collect()
    assert 1 <= len(res) <= 2
    assert all(0 < r["score"] <= 1.0 for r in res)


def test_inst_rule_fires_case_insensitively(spark):
    df = spark.createDataFrame([("hello [INST] x",), ("fine",)], "text string")
    got = [r["first_rule"] for r in G.injection_flags(df).collect()]
    assert got[0] == G.INJECTION_PATTERNS.index(r"\[INST\]") and got[1] is None


def test_duplicate_rows_nulls_equal(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), ("b", "x"), ("b", "x")],
                               "p string, q string")
    assert VA.duplicate_rows(df).first()["n_duplicates"] == 3


@settings(max_examples=10, deadline=None)
@given(st.integers(min_value=1, max_value=7))
def test_profile_invariant_under_repartitioning(spark, parts):
    df = spark.range(0, 300).select((F.col("id") * 7 % 13).cast("double").alias("x"),
                                    (F.col("id") % 5).cast("double").alias("y"))
    a = P.numeric_profile(df).orderBy("column_name").collect()
    b = P.numeric_profile(df.repartition(parts)).orderBy("column_name").collect()
    assert a == b


def test_folds_partition_rows(spark):
    from tablekit.operators.model import holdout_split, kfold_assign
    df = spark.range(0, 1000).select(F.col("id").cast("string").alias("k"))
    f = kfold_assign(holdout_split(df, "k"), "k").groupBy("fold").count().collect()
    assert sum(r["count"] for r in f) == 1000 and len(f) == 5


def test_exact_quantiles_equal_pandas(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"a": rng.integers(0, 7, 500).astype(float),     # many ties
                        "b": rng.normal(0, 1, 500), "c": [np.nan] * 499 + [3.5]})
    pdf.loc[::17, "b"] = None
    df = spark.createDataFrame(pdf).repartition(5)
    got = {r["column_name"]: r["q"] for r in P.exact_quantiles(df, ["a", "b", "c"], [0, 0.25, 0.5, 0.9, 1]).collect()}
    for c in ("a", "b", "c"):
        assert np.allclose(got[c], pdf[c].quantile([0, 0.25, 0.5, 0.9, 1]))
    profile = {r["column_name"]: r for r in P.numeric_profile(df).collect()}
    assert profile["b"]["p50"] == round(pdf["b"].quantile(0.5), 4)
    assert P.exact_quantiles(df.limit(0), ["a"], [0.5]).count() == 0


@pytest.mark.parametrize("accuracy, at_most", [(10_000, 1 << 16), (20, 12), (5, 1)])
def test_bracketed_quantiles_of_hot_unique_and_odd_columns(spark, accuracy, at_most):
    """80 % equal, all unique, constant, missing and infinite values; coarse sketches and
    small brackets go through refinement, opened brackets and hot values."""
    from tablekit.functions.quantiles import column_quantiles
    rng = np.random.default_rng(4)
    n = 4000
    pdf = pd.DataFrame({"hot": np.where(rng.random(n) < 0.8, 1.5, rng.normal(0, 9, n)), "unique": rng.permutation(n) * 1.25,
                        "const": np.full(n, -3.0), "one": [7.0] + [None] * (n - 1), "two": rng.integers(0, 2, n).astype(float),
                        "skew": np.exp(rng.normal(0, 4, n)), "none": [None] * n})
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.itertuples(index=False)], ", ".join(f"{c} double" for c in pdf)).repartition(7)
    ps = [0, 0.1, 0.25, 0.5, 0.75, 0.9999, 1]
    got = column_quantiles(df, list(pdf), ps, at_most=at_most, accuracy=accuracy)
    assert got.pop("none") is None
    for c, q in got.items():
        assert np.allclose(q, pdf[c].dropna().astype(float).quantile(ps), rtol=1e-12), c


def test_hot_value_is_one_row_before_any_task_orders_it(spark):
    from tablekit.functions.quantiles import value_counts_ranged, value_quantiles
    df = spark.range(0, 200_000, numPartitions=8).select(F.when(F.col("id") % 10 < 8, 0.0).otherwise(F.col("id").cast("double")).alias("value"), (F.col("id") % 2).alias("k"))
    ranged = value_counts_ranged(df, ["k"], 8)
    rows = [r["n"] for r in ranged.groupBy("pid").agg(F.count("*").alias("n")).collect()]
    assert ranged.where("value = 0").count() == 2 and max(rows) < 4 * 40_002 / 8
    q = {r["k"]: r["q"] for r in value_quantiles(df, ["k"], [0.5, 0.95]).collect()}
    pdf = df.toPandas()
    for k, g in pdf.groupby("k"):
        assert np.allclose(q[k], g["value"].quantile([0.5, 0.95]))


def test_target_distribution_fences_and_group_medians(spark):
    from tablekit.operators.extras import group_features_full, winsorize
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"y": rng.gamma(1.5, 2.0, 400), "g": rng.choice(["hot", "b", "c"], 400, p=[0.8, 0.15, 0.05])})
    df = spark.createDataFrame(pdf)
    assert P.target_distribution(df, "y").first()["p90"] == round(pdf["y"].quantile(0.9), 2)
    q1, q3 = pdf["y"].quantile([0.25, 0.75])
    clipped = winsorize(df, ["y"], k=0.5).toPandas()
    assert np.isclose(clipped["y"].max(), q3 + 0.5 * (q3 - q1))
    got = {r["g"]: r["g__y_median"] for r in group_features_full(df, "g", ["y"]).select("g", "g__y_median").distinct().collect()}
    assert all(np.isclose(got[g], v) for g, v in pdf.groupby("g")["y"].median().items())


def test_duplicate_rows_to_the_microsecond_and_zero(spark):
    from datetime import datetime
    from tablekit.operators.validate import duplicate_rows
    t = datetime(2024, 1, 1, 12, 0, 0)
    ts = spark.createDataFrame([(t.replace(microsecond=1),), (t.replace(microsecond=2),)], "t timestamp")
    assert duplicate_rows(ts).count() == 0
    cases = {"zero": [(0.0, "a"), (-0.0, "a")], "nan": [(float("nan"), None), (float("nan"), None)]}
    for rows in cases.values():
        df = spark.createDataFrame(rows, "x double, s string")
        assert duplicate_rows(df).first()["n_duplicates"] == df.count() - df.distinct().count() == 1
    moved = spark.createDataFrame([(None, "a"), ("a", None), ("", "a"), ("a", "")], "p string, q string")
    assert duplicate_rows(moved).count() == 0


def test_import_audit_reads_whole_lists(spark):
    from tablekit.operators.scan import import_audit
    code = "import os, subprocess as s\nimport numpy, socket.io; from . import x\n  from ..shutil import a\n# import ctypes\nimport json"
    df = spark.createDataFrame([(1, code)], "k int, text string")
    assert sorted(r["module"] for r in import_audit(df, keys=["k"], allowed=["numpy", "json"]).collect()) == ["os", "shutil", "socket", "subprocess"]


def test_stream_batches_late_and_retried(spark, tmp_path):
    from datetime import datetime
    from tablekit.operators.events import run_summary
    from tablekit.sources.io import EVENT_SCHEMA
    from tablekit.streaming import run_index as RI
    row = lambda i, run, day, kind="critique": (i, run, "x", kind, datetime(2024, 3, day), '{"cv_mse_mean": %d, "model": "m"}' % (i or 0))
    index = str(tmp_path / "index")
    assert RI.latest_index(spark, index) is None
    batches = [[row(1, "r1", 30), row(2, "r2", 30, "model_result")], [row(3, "r1", 1), row(1, "r1", 30), row(4, "r3", 2)], [row(5, "r2", 3, "model_result"), row(None, "r3", 1)]]
    frames = [spark.createDataFrame(b, EVENT_SCHEMA) for b in batches]
    for epoch, f in enumerate(frames):
        RI.merge_batch(f, epoch, index)
        RI.merge_batch(f, epoch, index)          # the epoch is tried again
    everything = frames[0].union(frames[1]).union(frames[2])
    want = run_summary(RI.distinct_events(everything)).orderBy("run_id").collect()
    assert RI.latest_index(spark, index).orderBy("run_id").collect() == want
    (tmp_path / "index" / "v=000000000002").joinpath("_SUCCESS").unlink()
    assert RI.latest_index(spark, index).count() == 3
