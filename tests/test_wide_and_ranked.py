"""Top values, co-moments, rank correlation, running minima and permutations against plain
computations, with hot, tied, missing and constant values; shapes of their plans."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablekit.functions.comoments import co_moments, pair_correlation
from tablekit.functions.joins import running_min
from tablekit.operators import extras as X
from tablekit.operators import profile as P


def frame(spark, pdf, parts=5):
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in pdf)).repartition(parts)


@pytest.mark.parametrize("top", [1, 3, 5, 40])
def test_top_values_with_near_ties_and_long_common_openings(spark, top):
    rng = np.random.default_rng(1)
    opening = "https://host.example.net/a/very/long/common/opening/"
    near = [v for i in range(30) for v in [f"v{i:02d}"] * (20 + i % 2)]            # counts 20 and 21
    tied = [opening + f"{i:04d}" for i in range(len(near))]                        # all of them once
    hot = ["" if i % 3 else rng.choice(["é", "z", "\U0001f600", "é"]) for i in range(len(near))]
    rows = [(None if i % 50 == 0 else a, b, c, i % 7 == 0) for i, (a, b, c) in enumerate(zip(near, tied, hot))]
    df = spark.createDataFrame(rows, "a string, b string, c string, d boolean").repartition(6)
    got = {}
    for r in P.categorical_profile(df, top=top).collect():
        got.setdefault(r["column_name"], []).append((r["rank"], r["value"], r["cnt"], r["n_distinct"]))
    for at, c in enumerate("abcd"):
        counts = Counter(str(r[at]).lower() if c == "d" else r[at] for r in rows if r[at] is not None)
        first = sorted(counts.items(), key=lambda t: (-t[1], t[0].encode()))[:top]
        assert sorted(got[c]) == [(i + 1, v, n, len(counts)) for i, (v, n) in enumerate(first)]


def test_top_values_of_nothing(spark):
    df = spark.createDataFrame([(None, 1)], "a string, b int")
    assert P.categorical_profile(df).count() == 0 and P.categorical_profile(df.limit(0)).count() == 0


def test_no_text_is_a_shuffle_key_of_the_counts(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/documents.parquet")
    plan = P.categorical_profile(df)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "hashpartitioning" in line:
            assert "value" not in line.split("hashpartitioning(")[1]


def wide(n, p, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * 10.0 ** rng.integers(-3, 4, p) + 10.0 ** rng.integers(0, 6, p)
    x[:, 1] = 3 * x[:, 0] + rng.normal(size=n) * 1e-3 * x[:, 0].std()
    x[rng.random((n, p)) < 0.1] = np.nan
    x[:, 2] = 7.25
    x[:, 3] = np.nan
    return pd.DataFrame(x, columns=[f"c {i}" for i in range(p)])


@pytest.mark.parametrize("block", [1024, 16])
def test_co_moments_equal_pairwise_correlations(spark, block):
    pdf = wide(400, 40, 2)
    want = pdf.corr(min_periods=2).to_numpy()
    got = co_moments(frame(spark, pdf), list(pdf), block).select("i", "j", "n", pair_correlation().alias("r")).collect()
    assert {(r["i"], r["j"]) for r in got} == {(i, j) for i in range(40) for j in range(i + 1, 40) if 3 not in (i, j)}
    for r in got:
        if 2 in (r["i"], r["j"]):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(want[r["i"], r["j"]], abs=1e-7)
            assert r["n"] == (pdf.iloc[:, r["i"]].notna() & pdf.iloc[:, r["j"]].notna()).sum()


def test_five_hundred_columns_in_one_scan(spark, tmp_path):
    pdf = wide(120, 500, 3)
    frame(spark, pdf, 3).write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    got = {(r["col1"], r["col2"]): r["corr"] for r in P.multicollinear_pairs(df, threshold=0.35).collect()}
    want = pdf.corr(min_periods=2).abs().to_numpy()
    names = list(pdf)
    pairs = {(names[i], names[j]): want[i, j] for i in range(500) for j in range(i + 1, 500) if want[i, j] > 0.35 and 2 not in (i, j)}
    assert set(got) == set(pairs) and ("c 0", "c 1") in got
    assert all(got[k] == pytest.approx(pairs[k], abs=6e-5) for k in got)
    stays = co_moments(df.select(*[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(names)]), [f"x{i}" for i in range(500)])
    assert stays._jdf.queryExecution().executedPlan().toString().count("FileScan") == 0   # read once, before


def test_infinite_values_give_no_correlation(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, np.inf], "b": [1.0, 2, 3, 5], "c": [2.0, 1, 5, 4]})
    got = {(r["i"], r["j"]): r["r"] for r in co_moments(frame(spark, pdf, 2), list("abc")).select("i", "j", pair_correlation().alias("r")).collect()}
    assert got[0, 1] is None and got[0, 2] is None and got[1, 2] == pytest.approx(pdf["b"].corr(pdf["c"]))


def test_spearman_with_hot_missing_and_constant_values(spark):
    rng = np.random.default_rng(4)
    n = 600
    y = np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n))
    pdf = pd.DataFrame({"y": y, "mono": np.exp(y), "hot": np.where(rng.random(n) < 0.7, 1.0, -y), "noise": rng.normal(size=n),
                        "const": np.ones(n), "holes": np.where(rng.random(n) < 0.5, np.nan, y ** 3), "none": np.full(n, np.nan)})
    pdf.loc[rng.random(n) < 0.1, "y"] = np.nan
    got = {r["column_name"]: r for r in X.spearman_leakage(frame(spark, pdf), "y", "key").collect()}
    ranks = pdf.rank()
    for c in ("mono", "hot", "noise", "holes"):
        assert got[c]["rho"] == pytest.approx(ranks[c].corr(ranks["y"]), abs=6e-5), c
    assert got["const"]["rho"] is None and got["none"]["rho"] is None and got["mono"]["leakage_suspect"]


def test_spearman_shuffles_do_not_grow_with_the_columns(spark):
    def exchanges(p):
        df = spark.range(50).select(F.col("id").cast("double").alias("y"), *[F.rand(i).alias(f"x{i}") for i in range(p)])
        return X.spearman_leakage(df, "y", "key")._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(2) == exchanges(12)


def test_running_minimum_of_a_hot_group_is_spread(spark):
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 3 else f"g{i % 4}" if i % 4 else None, int(t), None if i % 11 == 0 else float(rng.normal())) for i, t in enumerate(rng.permutation(3000))]
    df = spark.createDataFrame(rows, "g string, t int, x double")
    out = running_min(df, ["g"], ["t"], "x", "least", 8)
    pids = df.repartitionByRange(8, "g", "t").where("g = 'hot'").select(F.spark_partition_id()).distinct().count()
    assert pids > 3
    seen = {}
    for g, t, x in sorted(rows, key=lambda r: r[1]):
        before = seen.setdefault(g, [])
        before.append((t, min([v for v in (x, before[-1][1] if before else None) if v is not None], default=None)))
    assert sorted((r["g"] or "", r["t"], r["least"]) for r in out.collect()) == sorted((g or "", t, m) for g, s in seen.items() for t, m in s)
    assert running_min(df.limit(0), ["g"], ["t"], "x", "least", 8).count() == 0


def test_permutation_importance_by_hand(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"key": [f"k{i}" for i in range(200)], "a": rng.normal(size=200), "b": rng.normal(size=200)})
    pdf["y"] = 2 * pdf["a"] + 0.1 * pdf["b"]
    score = lambda d: d.withColumn("prediction", 2 * F.col("a") + 0.5 * F.col("b"))
    got = {r["feature"]: r["mse_increase"] for r in X.permutation_importance(spark.createDataFrame(pdf), score, "y", ["a", "b"], "key", 7).collect()}
    pdf = pdf.sort_values("key").reset_index(drop=True)
    at = sorted(range(200), key=lambda i: hashlib.md5(f"7-{pdf['key'][i]}".encode()).hexdigest())
    mse = lambda a, b: float(((2 * a + 0.5 * b - pdf["y"].to_numpy()) ** 2).mean())
    a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
    assert got["a"] == pytest.approx(mse(a[at], b) - mse(a, b), abs=6e-5)
    assert got["b"] == pytest.approx(mse(a, b[at]) - mse(a, b), abs=6e-5)
