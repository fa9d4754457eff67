"""Fitted models against independent computations on small frames."""

import json
import math

import numpy as np
import pytest

from tablekit.operators import model as M
from tablekit.operators import validate as VA


@pytest.fixture(scope="module")
def frame(spark):
    r = np.random.default_rng(3)
    a, b = r.normal(size=240), r.gamma(2.0, size=240)
    y = 3 * a - 2 * b + r.normal(size=240) * 0.1
    rows = [(f"k{i}", float(a[i]), float(b[i]), "xyz"[i % 3], float(y[i])) for i in range(240)]
    return spark.createDataFrame(rows, "key string, a double, b double, c string, y double").repartition(2)


def test_ridge_solves_the_normal_equations(frame):
    train, _, log = M.prepared_folds(frame, "y", ["a", "b", "c"], "key", 3)[0]
    assert not log
    rows = train.collect()
    x, y = np.array([r.features.toArray() for r in rows]), np.array([r.y for r in rows])
    model = M.fit_ridge(train, "y", alpha=2.0).models[0]
    w = model.coefficients.toArray()
    residual = y - x @ w - model.intercept
    assert residual.sum() == pytest.approx(0, abs=1e-6)
    assert x.T @ residual == pytest.approx(2.0 * w, abs=1e-6)


def test_tuning_on_shared_folds_equals_cross_validation(frame):
    out = M.tune_hyperparameters(frame, "y", ["a", "b", "c"], "key", "ridge", n_trials=3, k=3).collect()
    assert sorted(r["rank"] for r in out) == [1, 2, 3] and sum(r["holdout_mse"] is not None for r in out) == 1
    assert min(out, key=lambda r: r["rank"])["holdout_mse"] is not None
    for r in out:
        cv = M.cross_validate(frame, "y", ["a", "b", "c"], "key", "ridge", 3, **json.loads(r["params"])).first()
        assert r["cv_mse_mean"] == pytest.approx(cv["cv_mse_mean"], abs=1e-9)
        assert r["cv_rmse_mean"] == pytest.approx(math.sqrt(cv["cv_mse_mean"]), abs=1e-9)


def test_ridge_trials_share_a_scan(frame, monkeypatch):
    """All alphas of a fold come from one scan: a single fit, the best one's, is left."""
    fits = []
    whole = M.fit_ridge
    monkeypatch.setattr(M, "fit_ridge", lambda *a, **b: (fits.append(1), whole(*a, **b))[1])
    out = M.tune_hyperparameters(frame, "y", ["a", "b", "c"], "key", "ridge", n_trials=4, k=3)
    assert out.count() == 4 and len(fits) == 1


def test_ridge_trials_with_missing_labels_or_a_log_label(frame):
    skewed = frame.selectExpr("key", "a", "b", "c", "exp(y) as y")
    out = M.tune_hyperparameters(skewed, "y", ["a", "b", "c"], "key", "ridge", n_trials=2, k=3).collect()
    for r in out:
        cv = M.cross_validate(skewed, "y", ["a", "b", "c"], "key", "ridge", 3, **json.loads(r["params"])).first()
        assert r["cv_mse_mean"] == pytest.approx(cv["cv_mse_mean"], rel=1e-6)
    train, held, log = M.prepared_folds(frame, "y", ["a", "b", "c"], "key", 3)[0]
    gaps = train.selectExpr("features", "if(y > 0, y, null) as y")
    assert M._ridge_errors(gaps, held, log, "y", [1.0]) is None and len(M._ridge_errors(train, held, log, "y", [1.0, 2.0])) == 2


def test_models_are_compared_on_splits_prepared_once(frame, monkeypatch):
    seen = []
    whole = M.fit_preprocess
    monkeypatch.setattr(M, "fit_preprocess", lambda *a: (seen.append(1), whole(*a))[1])
    quick = {"maxIter": 2, "maxDepth": 2}
    out = M.compare_models(frame, "y", ["a", "b", "c"], "key", ["ridge", "gradient_boosting", "none"], 3, **quick).collect()
    assert len(seen) == 4  # the holdout split and three folds
    by = {r["model"]: r for r in out}
    assert "unknown model" in by["none"]["error"] and by["none"]["rank"] == 3
    for m in ("ridge", "gradient_boosting"):
        one = M.train_and_evaluate(frame, "y", ["a", "b", "c"], "key", m, 3, **quick).first()
        assert by[m]["error"] is None and by[m]["holdout_mse"] == pytest.approx(one["holdout_mse"]) and by[m]["cv_mse_mean"] == pytest.approx(one["cv_mse_mean"])


def test_preprocessing_statistics(spark):
    rows = [(1.0, 5, "b", None), (None, 5, "a", None), (float("nan"), 5, "a", None), (4.0, None, None, None), (10.0, 5, "b", None)]
    df = spark.createDataFrame(rows, "x double, k int, c string, e string").coalesce(1)
    prep = M.fit_preprocess(df, ["x", "k", "c", "e"])
    x = np.array([1.0, 4.0, 4.0, 4.0, 10.0])
    assert prep.medians == {"x": 4.0, "k": 5.0} and prep.modes == {"c": "a", "e": None}
    assert prep.means == {"x": pytest.approx(x.mean()), "k": 5.0} and prep.stds == {"x": pytest.approx(x.std()), "k": 0.0}
    assert {tuple(r) for r in prep.codes["c"].collect()} == {("a", 0), ("b", 1)} and prep.codes["e"].count() == 0
    got = prep.transform(df).collect()
    assert [r["c"] for r in got] == [1.0, 0.0, 0.0, 0.0, 1.0] and {r["e"] for r in got} == {-1.0} and {r["k"] for r in got} == {0.0}


def test_column_counts(spark):
    df = spark.createDataFrame([(1, "2.5", None), (2, "x", 1.0), (None, None, 2.0)], "a int, `b c` string, d double")
    assert {tuple(r) for r in VA.column_counts(df).collect()} == {("a", 3, 2, 2), ("b c", 3, 2, 1), ("d", 3, 2, 2)}
    names = spark.createDataFrame([("a",), ("gone",)], "column_name string")
    assert {tuple(r) for r in VA.with_counts(names, df).collect()} == {("a", 3, 2, 2), ("gone", 0, 0, 0)}
    assert {tuple(r) for r in VA.column_counts(df.limit(0)).collect()} == {("a", 0, 0, 0), ("b c", 0, 0, 0), ("d", 0, 0, 0)}
