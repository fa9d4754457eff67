"""Regression modelling on Spark ML.

Folds and the holdout split are hash columns of a key (stable under any
partitioning). Encoders and the preprocessing are fitted inside every fold on
that fold's training rows; fitted statistics are one-row aggregates (schema
sized) or small code tables joined back. Training itself is Spark ML
(``LinearRegression``, ``RandomForestRegressor``, ``GBTRegressor``,
``GBTClassifier``); cross-validation submits the folds' jobs side by side the
way ``CrossValidator`` does.
"""

from __future__ import annotations

import json
import math
import os
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekit.functions.comoments import co_moments
from tablekit.functions.joins import (BROADCAST_MAX_BYTES, bounded_broadcast, materialize,
                                      released, stored)
from tablekit.functions.quantiles import column_quantiles
from tablekit.functions.stats import (clean, clip, fold_of, numeric_columns,
                                      other_columns, r4, sample_skew)
from tablekit.operators import features as FE
from tablekit.session import checkpoint_dir, file_a_task

# Defaults of the modelling step.
SEED = 42
N_FOLDS = 5
HOLDOUT_FOLDS = 5          # one of five hash folds is the 20 % holdout
CLIP = (None, None)        # no range is assumed of a label; callers pass one
ZERO_INFLATION = 0.15
MIN_POSITIVE = 10
HIGH_CARD = 10
RIDGE_ALPHA = 10.0

# Model parameters, as Spark ML's tree learners have them. Settings without a
# counterpart there (leaf and weight penalties, bagging temperature) are left out.
PROFILES = {
    "ridge": {"alpha": RIDGE_ALPHA},
    "random_forest": {"numTrees": 300, "featureSubsetStrategy": "0.5", "minInstancesPerNode": 5,
                      "maxDepth": 30},
    "gradient_boosting": {"maxIter": 500, "stepSize": 0.05, "maxDepth": 5, "subsamplingRate": 0.8,
                          "minInstancesPerNode": 10},
    # boosted variants: leaf-heavy, depth-6 with column sampling, depth-6 regularised
    # (127 leaves are a tree of depth 7; column shares per tree and level multiply)
    "lightgbm": {"maxIter": 2000, "stepSize": 0.03, "maxDepth": 7, "subsamplingRate": 0.8,
                 "featureSubsetStrategy": "0.8", "minInstancesPerNode": 20, "minInfoGain": 0.01},
    "xgboost": {"maxIter": 2000, "stepSize": 0.03, "maxDepth": 6, "subsamplingRate": 0.8,
                "featureSubsetStrategy": "0.64", "minInstancesPerNode": 5},
    "catboost": {"maxIter": 2000, "stepSize": 0.03, "maxDepth": 6,
                 "minInstancesPerNode": 20, "minInfoGain": 0.0},
}
# Classifier settings per family (the two-stage model's first stage).
CLASSIFIERS = {
    "lightgbm": {"maxIter": 500, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8,
                 "featureSubsetStrategy": "0.8", "minInstancesPerNode": 20},
    "xgboost": {"maxIter": 500, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8,
                "featureSubsetStrategy": "0.8"},
    "catboost": {"maxIter": 500, "stepSize": 0.05, "maxDepth": 6},
    "gradient_boosting": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 5, "subsamplingRate": 0.8},
}
BOOSTED = ["lightgbm", "xgboost", "catboost"]
MODELS = ["ridge", "random_forest", "gradient_boosting", *BOOSTED, "ensemble", "two_stage"]


# ---------------------------------------------------------------------------
# M1 / M2: split and folds
# ---------------------------------------------------------------------------

def holdout_split(df: DataFrame, key: str, out: str = "split") -> DataFrame:
    """M1: 80/20 split by a hash of the key (fold 0 of 5 is the holdout)."""
    return df.withColumn(out, F.when(fold_of(key, HOLDOUT_FOLDS) == 0, "test").otherwise("train"))


def kfold_assign(df: DataFrame, key: str, k: int = N_FOLDS, out: str = "fold") -> DataFrame:
    """M2: fold 0..k-1 from a hash of 'cv-' || key, independent of the split."""
    return df.withColumn(out, fold_of(F.concat(F.lit("cv-"), F.col(key).cast("string")), k))


# ---------------------------------------------------------------------------
# preprocessing fitted on a training frame
# ---------------------------------------------------------------------------

@dataclass
class Prep:
    """Fitted F7+F9 (numeric) and F8+F10 (categorical) preprocessing."""
    numeric: list[str]
    categorical: list[str]
    medians: dict
    means: dict
    stds: dict
    modes: dict
    codes: dict = field(default_factory=dict)     # column → DataFrame(__v, __code)

    @property
    def feature_names(self) -> list[str]:
        return self.numeric + self.categorical

    def of(self, features: list[str]) -> "Prep":
        """The same for some of the columns: each column's statistics are its own."""
        return Prep([c for c in self.numeric if c in features], [c for c in self.categorical if c in features],
                    self.medians, self.means, self.stds, self.modes, self.codes)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.categorical:
            mode = self.modes.get(c)
            v = F.coalesce(F.col(c).cast("string"), F.lit(mode))
            out = (out.withColumn("__v", v).join(self.codes[c], "__v", "left")
                      .withColumn(c, F.coalesce(F.col("__code"), F.lit(-1)).cast("double"))
                      .drop("__v", "__code"))
        sel = []
        for c in out.columns:
            if c in self.numeric:
                med = self.medians.get(c)
                x = F.coalesce(clean(out, c).cast("double"), F.lit(med).cast("double"))
                sd = self.stds.get(c) or 1.0
                sel.append(((x - F.lit(self.means.get(c) or 0.0)) / F.lit(sd if sd != 0 else 1.0))
                           .alias(c))
            else:
                sel.append(F.col(c))
        return out.select(*sel)


def fit_preprocess(train: DataFrame, features: list[str]) -> Prep:
    """Fit on the training rows: medians, population mean/std after imputation, modes, and
    sorted category codes. Numeric columns take the scans of the exact medians, the first of
    which brings the moments too; categories of all columns are counted in one scan."""
    num = [c for c in numeric_columns(train) if c in features]
    cat = [c for c in other_columns(train) if c in features]
    med, means, stds = _fit_numeric(train, num) if num else ({}, {}, {})
    modes, codes = _fit_categories(train, cat) if cat else ({}, {})
    return Prep(num, cat, med, means, stds, modes, codes)


def _fit_numeric(train: DataFrame, cols: list[str]) -> tuple[dict, dict, dict]:
    """Medians, and mean and population std of the columns with their gaps filled by them."""
    at = [f"c{i}" for i in range(len(cols))]
    src = train.select(*[clean(train, c).cast("double").alias(a) for a, c in zip(at, cols)])
    also = [F.count(F.lit(1)).alias("rows"), *[x for a in at for x in (
        F.count(a).alias("k_" + a), F.avg(a).alias("mu_" + a), F.var_pop(a).alias("var_" + a))]]
    seen: list = []
    q = column_quantiles(src, at, [0.5], also=also, seen=seen)
    med, means, stds = {}, {}, {}
    for a, c in zip(at, cols):
        n, k = seen[0]["rows"], seen[0]["k_" + a]
        med[c], means[c], stds[c] = (float(q[a][0]), seen[0]["mu_" + a], seen[0]["var_" + a]) if k else (None, None, None)
        if k:
            full, off = k / n, (med[c] - means[c] if k < n else 0.0)
            means[c] += (1 - full) * off
            stds[c] = math.sqrt(max(full * stds[c] + full * (1 - full) * off * off, 0.0))
    return med, means, stds


def _fit_categories(train: DataFrame, cols: list[str]) -> tuple[dict, dict]:
    """Most frequent value (ties: smallest) and table of codes (__v, __code) of each column."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    counts = train.select(each.alias("e")).where(F.col("e.value").isNotNull()).groupBy("e.column", "e.value")
    counts = materialize(counts.agg(F.count(F.lit(1)).alias("n")))
    order = F.struct((-F.col("n")).alias("n"), F.col("value").alias("v"))
    found = {r["column"]: r for r in counts.groupBy("column").agg(
        F.min_by("value", order).alias("mode"), F.sum(F.octet_length("value") + 64).alias("bytes")).collect()}
    modes = {c: found[c]["mode"] if c in found else None for c in cols}
    small = [c for c in cols if c not in found or found[c]["bytes"] <= BROADCAST_MAX_BYTES]
    place = F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1
    numbered = materialize(counts.where(F.col("column").isin(small)).select(
        "column", F.col("value").alias("__v"), place.cast("bigint").alias("__code")))
    codes = {}
    for c in cols:
        if c in small:
            codes[c] = F.broadcast(numbered.where(F.col("column") == c).select("__v", "__code"))
        else:
            codes[c] = FE.fit_ordinal(counts.where(F.col("column") == c), "value")
    return modes, codes


def assemble(df: DataFrame, names: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol=out, handleInvalid="keep").transform(df)


# ---------------------------------------------------------------------------
# M3-M9: estimators
# ---------------------------------------------------------------------------

#: Rows of a task of a tree learner, which holds them in memory and reads them in each round.
TASK_ROWS = 250_000


def _tasks_wanted(df: DataFrame, rows: int, task_rows: int | None = None) -> int:
    """The number of tasks that ``rows`` ask for, or 0 where the table has as many."""
    tasks = -(-rows // (task_rows or TASK_ROWS))
    return tasks if tasks > df.rdd.getNumPartitions() else 0


def dealt(df: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Deal rows out so that their number sets that of the tasks; fewer stay where they are."""
    tasks = _tasks_wanted(df, df.count(), task_rows)
    return df.repartition(tasks) if tasks else df


def _tree_params(est, params: dict):
    ok = {k: v for k, v in params.items() if est.hasParam(k)}
    est._set(**ok)
    return est


def _fit_trees(est, df: DataFrame):
    """Fit with rows dealt into tasks of ``TASK_ROWS`` at most; a large matrix that is kept has
    files of so many, which are read apart and need no shuffle."""
    checkpoint_dir(df.sparkSession)  # where boosting cuts the lineage of its rounds
    if not _tasks_wanted(df, df.count()):
        return est.fit(df)
    with file_a_task(df.sparkSession):
        return est.fit(dealt(df.select("*")))


@dataclass
class Fitted:
    """A fitted regressor over the ``features`` column, with a predict method."""
    kind: str
    models: list
    const: float | None = None
    log_target: bool = False

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if self.kind == "two_stage":
            clf, reg = self.models
            p = clf.transform(df).withColumn("__p", vector_to_array("probability")[1]).drop(
                "rawPrediction", "probability", "prediction")
            if reg is None:
                pos = F.lit(self.const)
            else:
                p = reg.transform(p)
                pos = F.col("prediction")
            res = p.withColumn("__y", F.col("__p") * pos).drop("__p", "prediction")
            return res.withColumnRenamed("__y", out)
        if self.kind == "ensemble":
            cur, cols = df, []
            for i, m in enumerate(self.models):
                cur = m.transform(cur).withColumnRenamed("prediction", f"__e{i}")
                cols.append(F.col(f"__e{i}"))
            avg = sum(cols[1:], cols[0]) / len(cols)
            return cur.withColumn(out, avg).drop(*[f"__e{i}" for i in range(len(cols))])
        res = self.models[0].transform(df)
        return res.withColumnRenamed("prediction", out) if out != "prediction" else res


def fit_ridge(df: DataFrame, label: str = "label", alpha: float = RIDGE_ALPHA) -> Fitted:
    """M3: closed-form ridge — normal-equation solver, no standardisation,
    ``regParam = alpha / n · stddev_pop(y)`` (Spark scales the penalty by the
    label's standard deviation)."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("sd")).first()
    sd = r["sd"] or 1.0
    reg = alpha / max(r["n"], 1) * sd
    lr = LinearRegression(featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=0.0,
                          standardization=False, solver="normal", fitIntercept=True)
    return Fitted("ridge", [lr.fit(df)])


def fit_random_forest(df: DataFrame, label: str = "label", **overrides) -> Fitted:
    """M4."""
    p = {**PROFILES["random_forest"], **overrides}
    est = _tree_params(RandomForestRegressor(featuresCol="features", labelCol=label, seed=SEED), p)
    return Fitted("random_forest", [_fit_trees(est, df)])


def fit_gbt(df: DataFrame, label: str = "label", profile: str = "gradient_boosting",
            **overrides) -> Fitted:
    """M5 / M6: gradient-boosted trees under a named parameter profile."""
    p = {**PROFILES[profile], **overrides}
    est = _tree_params(GBTRegressor(featuresCol="features", labelCol=label, seed=SEED), p)
    return Fitted(profile, [_fit_trees(est, df)])


def fit_classifier(df: DataFrame, label: str = "label", profile: str = "lightgbm",
                   **overrides):
    """M7: P(y > 0) with a boosted classifier of one family's settings."""
    p = {**CLASSIFIERS[profile], **overrides}
    d = df.select("features", (F.col(label) > 0).cast("double").alias("__pos"))
    est = _tree_params(GBTClassifier(featuresCol="features", labelCol="__pos", seed=SEED), p)
    return _fit_trees(est, d)


def fit_ensemble(df: DataFrame, label: str = "label", members: list[str] = tuple(BOOSTED),
                 known: dict[str, Fitted] | None = None, **overrides) -> Fitted:
    """M8: equal-weight mean of the boosted members. ``known``: those already fitted on ``df``
    with the same settings; a member's fit depends on nothing else."""
    known = known or {}
    ms = [(known.get(m) or fit_gbt(df, label, m, **overrides)).models[0] for m in members]
    return Fitted("ensemble", ms)


def fit_two_stage(df: DataFrame, label: str = "label", **overrides) -> Fitted:
    """M9: P(y > 0) × E[y | y > 0]; fewer than 10 positives → their mean."""
    clf = fit_classifier(df, label, **overrides)
    pos = FE.positive_subset(df, label)
    r = pos.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("m")).first()
    if r["n"] < MIN_POSITIVE:
        return Fitted("two_stage", [clf, None], const=float(r["m"] or 0.0))
    return Fitted("two_stage", [clf, fit_gbt(pos, label, "lightgbm", **overrides).models[0]])


def fit_model(name: str, df: DataFrame, label: str = "label", known: dict[str, Fitted] | None = None,
              **overrides) -> Fitted:
    if name == "ridge":
        return fit_ridge(df, label, overrides.get("alpha", RIDGE_ALPHA))
    if name == "random_forest":
        return fit_random_forest(df, label, **overrides)
    if name in ("gradient_boosting", *BOOSTED):
        return fit_gbt(df, label, name, **overrides)
    if name == "ensemble":
        return fit_ensemble(df, label, known=known, **overrides)
    if name == "two_stage":
        return fit_two_stage(df, label, **overrides)
    raise ValueError(f"unknown model {name!r}; choose from {MODELS}")


# ---------------------------------------------------------------------------
# Metrics (aggregates)
# ---------------------------------------------------------------------------

def prediction_summary(df: DataFrame, pred: str = "prediction") -> DataFrame:
    """N, mean, population std, min, max (4 decimals)."""
    p = F.col(pred)
    return df.agg(F.count(p).cast("bigint").alias("n"), r4(F.avg(p)).alias("mean"),
                  r4(F.stddev_pop(p)).alias("std"), r4(F.min(p)).alias("min"),
                  r4(F.max(p)).alias("max"))


def _metric_aggs(y: Column, p: Column) -> list[Column]:
    e = p - y
    n = F.count(e)
    sse = F.sum(e * e)
    return [n.cast("bigint").alias("n"), (sse / n).alias("mse"), F.sqrt(sse / n).alias("rmse"),
            F.avg(F.abs(e)).alias("mae"),
            (1 - sse / F.nullif(F.var_pop(F.when(e.isNotNull(), y)) * n, F.lit(0.0))).alias("r2")]


def regression_metrics(df: DataFrame, label: str, pred: str = "prediction",
                       by: list[str] = ()) -> DataFrame:
    """M17 (and M19 with ``by``): MSE, RMSE, MAE, R² = 1 − SSE / SST."""
    g = df.groupBy(*by) if by else df
    out = g.agg(*_metric_aggs(F.col(label).cast("double"), F.col(pred).cast("double")))
    return out.select(*by, "n", *[r4(F.col(c)).alias(c) for c in ("mse", "rmse", "mae", "r2")])


def metrics_by_group(df: DataFrame, label: str, by: list[str], pred: str = "prediction") -> DataFrame:
    return regression_metrics(df, label, pred, by)


# ---------------------------------------------------------------------------
# The training job
# ---------------------------------------------------------------------------

@dataclass
class Prepared:
    """A train (or fold-train) frame as a model matrix (features, label), and the fitted
    encoders and preprocessing that do the same to other rows. Models tried on the same rows
    share it."""
    matrix: DataFrame
    encoders: list
    prep: Prep
    log_target: bool


def _encode(train: DataFrame, label: str, features: list[str], key: str):
    """Target-encode high-cardinality categoricals: out-of-fold on train, and encoders with
    full-train statistics for other rows."""
    cats = [c for c in other_columns(train.select(*features))]
    nd = {}
    if cats:
        from tablekit.operators.profile import distinct_counts
        nd = {r["column_name"]: r["n_distinct"] for r in distinct_counts(train, cats).collect()}
    high = [c for c in cats if nd.get(c, 0) > HIGH_CARD]
    sums = FE.category_sums(train, high, label, key) if high else None
    enc = [FE.fit_target_encoding(train, c, label, out=c, sums=sums) for c in high]
    tr = train
    for c in high:
        tr = FE.target_encode_oof(tr, c, label, key, out=c, sums=sums)
    return tr, enc


def _encode_fit(train: DataFrame, label: str, features: list[str], key: str):
    """``_encode``, then fit the preprocessing on the encoded rows."""
    tr, enc = _encode(train, label, features, key)
    feats = [c for c in features if c in tr.columns]
    prep = fit_preprocess(tr, feats)
    return tr, enc, prep


def _apply(df: DataFrame, encoders: list, prep: Prep) -> DataFrame:
    for e in encoders:
        df = e.transform(df)
    return assemble(prep.transform(df), prep.feature_names)


def _log_rule(train: DataFrame, label: str) -> bool:
    r = train.agg(sample_skew(F.col(label).cast("double")).alias("sk"),
                  F.min(label).alias("mn")).first()
    return bool(r["sk"] is not None and r["sk"] > 1 and r["mn"] is not None and r["mn"] >= 0)


def encode_and_log(train: DataFrame, test: DataFrame, label: str, features: list[str], key: str):
    """high-cardinality target encoding (out-of-fold on train, full-train
    statistics on test), the log rule, and log1p of the label when it applies.
    Returns (train, test, log_applied)."""
    log = _log_rule(train, label)
    tr, enc = _encode(train, label, features, key)
    te = test
    for e in enc:
        te = e.transform(te)
    if log:
        tr = tr.withColumn(label, F.log1p(label))
    return tr, te, log


def _matrix(tr: DataFrame, prep: Prep, label: str, log: bool, keep: bool) -> DataFrame:
    """(features, label); ``keep``: for learners that scan it many times. Of more rows than
    ``TASK_ROWS`` a task it is written in files of so many (a few bytes a row, where memory takes
    8 a feature), else persisted."""
    mat = assemble(prep.transform(tr), prep.feature_names).select("features", label)
    if log:
        mat = mat.withColumn(label, F.log1p(label))
    if not keep:
        return mat
    if _tasks_wanted(mat, tr.count()):
        return stored(mat, "matrix", TASK_ROWS)
    mat = mat.persist()
    mat.count()
    return mat


def _scans(model: str) -> bool:
    """Iterative learners scan their matrix many times; ridge does once, from the inputs."""
    return model != "ridge"


def prepare(train: DataFrame, label: str, features: list[str], key: str, keep: bool = True) -> Prepared:
    """Encode + preprocess + (log target); the caller releases a kept matrix."""
    log = _log_rule(train, label)
    tr, enc, prep = _encode_fit(train, label, features, key)
    return Prepared(_matrix(tr, prep, label, log, keep), enc, prep, log)


def fit_prepared(p: Prepared, label: str, model: str, known: dict[str, Fitted] | None = None, **overrides) -> Fitted:
    fitted = fit_model(model, p.matrix, label, known=known, **overrides)
    fitted.log_target = p.log_target
    return fitted


def fit_once(train: DataFrame, label: str, features: list[str], key: str, model: str,
             **overrides):
    """Encode + preprocess + (log target) + fit on ``train``."""
    p = prepare(train, label, features, key, _scans(model))
    fitted = fit_prepared(p, label, model, **overrides)
    released(p.matrix)
    return fitted, p.encoders, p.prep


def predict_with(fitted: Fitted, enc, prep, df: DataFrame, lo=CLIP[0], hi=CLIP[1]) -> DataFrame:
    """Score: encoders → preprocessing → model → expm1 (if log) → clip."""
    p = fitted.predict(_apply(df, enc, prep))
    if fitted.log_target:
        p = p.withColumn("prediction", F.expm1("prediction"))
    if lo is not None or hi is not None:
        p = p.withColumn("prediction", clip("prediction", lo, hi))
    return p.drop("features")


def _kept(df: DataFrame, derived: DataFrame) -> tuple[DataFrame, bool]:
    """``derived``, which adds a few columns to ``df``, written once unless ``df`` is persisted:
    then the columns are computed again, as a second copy of the rows would take the memory."""
    if df.storageLevel.useMemory or df.storageLevel.useDisk or (derived is df and hasattr(df, "_stored_at")):
        return derived, False
    return stored(derived, "folds"), True


def _evaluate(splits: list[tuple[DataFrame, DataFrame]], label: str, features: list[str], key: str,
              models: list[str], parallelism: int, keep: bool = False, **overrides) -> list[dict]:
    """Per split (train, held) and model: (metrics of the held rows, whether the label was
    logged, with ``keep`` the fitted model of the first split and its encoders and
    preprocessing), or the exception. A split is prepared once for all models, and an ensemble
    takes the members fitted before it; trees are let go when the split is done."""
    def fit_and_measure(p, held, model, known, kept):
        try:
            fitted = fit_prepared(p, label, model, known=known, **overrides)
            measured = regression_metrics(predict_with(fitted, p.encoders, p.prep, held), label).first()
            if model in BOOSTED and "ensemble" in models:
                known[model] = fitted
            return measured, p.log_target, (fitted, p.encoders, p.prep) if kept else None
        except Exception as e:  # noqa: BLE001 — the caller raises it or makes it a result row
            return e

    def one(i):
        train, held = splits[i]
        try:
            p = prepare(train, label, features, key, any(map(_scans, models)))
        except Exception as e:  # noqa: BLE001
            return dict.fromkeys(models, e)
        known: dict[str, Fitted] = {}
        out = {m: fit_and_measure(p, held, m, known, keep and i == 0) for m in models}
        released(p.matrix)
        return out

    # splits are independent sets of jobs: submitted side by side, as CrossValidator does
    with ThreadPool(parallelism) as pool:
        return pool.map(inheritable_thread_target(one), range(len(splits)), chunksize=1)


def _results(found: list[dict], model: str) -> list[tuple]:
    """The model's results of all splits; raises the first error."""
    for f in found:
        if isinstance(f[model], Exception):
            raise f[model]
    return [f[model] for f in found]


def _fold_splits(d: DataFrame, fold_col: str, k: int) -> list[tuple[DataFrame, DataFrame]]:
    return [(d.where(F.col(fold_col) != f), d.where(F.col(fold_col) == f)) for f in range(k)]


def _cv_summary(mse: list[float]) -> tuple[float, float, float]:
    """Mean and population std of the folds' MSE, and RMSE = sqrt(mean MSE)."""
    mean = sum(mse) / len(mse)
    return mean, math.sqrt(sum((x - mean) ** 2 for x in mse) / len(mse)), math.sqrt(mean)


def cross_validate(df: DataFrame, label: str, features: list[str], key: str, model: str,
                   k: int = N_FOLDS, fold_col: str | None = None, parallelism: int = 2,
                   **overrides) -> DataFrame:
    """Per fold refit everything on the other folds; MSE per fold, then
    mean, population std and RMSE = sqrt(mean MSE). Returns one row."""
    fc = fold_col or "__cvfold"
    d, own = _kept(df, df if fold_col else kfold_assign(df, key, k, fc))
    found = _evaluate(_fold_splits(d, fc, k), label, features, key, [model], parallelism, **overrides)
    if own:
        released(d)
    rows = [r["mse"] for r, *_ in _results(found, model)]
    mean, std, rmse = _cv_summary(rows)
    return df.sparkSession.createDataFrame(
        [(model, mean, std, rmse, rows)],
        "model string, cv_mse_mean double, cv_mse_std double, cv_rmse_mean double, fold_mse array<double>")


@dataclass
class Member:
    """A model of an ensemble: its kind, its features and its parameters."""
    model: str
    features: list[str]
    params: dict = field(default_factory=dict)


def _fit_members(train: DataFrame, label: str, key: str, members: dict[str, Member]) -> dict[str, tuple]:
    """The members' columns are prepared together, as each column's statistics are its own."""
    log = _log_rule(train, label)
    tr, enc, prep = _encode_fit(train, label, list(dict.fromkeys(f for m in members.values() for f in m.features)), key)
    out = {}
    for n, m in members.items():
        own = prep.of(m.features)
        p = Prepared(_matrix(tr, own, label, log, _scans(m.model)), [e for e in enc if e.cat in m.features], own, log)
        out[n] = fit_prepared(p, label, m.model, **m.params), p.encoders, own
        released(p.matrix)
    return out


def member_predictions(fitted: dict[str, tuple], df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and a column of predictions for each member. Preprocessing overwrites feature
    columns, so the row as it came travels in a struct and is unpacked for each member: no
    join by key, which need not be unique."""
    cur = df.select(*[F.col(c).alias(f"__k_{c}") for c in keep], F.struct(*df.columns).alias("__row"))
    for name, (model, enc, prep) in fitted.items():
        done = cur.columns
        p = predict_with(model, enc, prep, cur.select("*", "__row.*"))
        cur = p.select(*done, F.col("prediction").alias(name))
    return cur.select(*[F.col(f"__k_{c}").alias(c) for c in keep], *fitted)


def out_of_fold(df: DataFrame, label: str, key: str, members: dict[str, Member], k: int = N_FOLDS,
                fold_col: str | None = None, parallelism: int = 2) -> DataFrame:
    """The cross-fitting table: ``key``, ``label``, ``fold`` and per member a column
    with the prediction of the model that did not see the row (encoders and preprocessing
    included: they are fitted on the other folds too). ``fold_col`` takes folds as they are;
    those without rows are passed over. Written once; the models are not kept."""
    d = (df.withColumn("fold", F.col(fold_col)) if fold_col else kfold_assign(df, key, k, "fold"))
    d = stored(d, "folds")  # each fold and step reads it
    folds = sorted(r["fold"] for r in d.select("fold").distinct().collect())

    def one(f):
        fitted = _fit_members(d.where(F.col("fold") != f), label, key, members)
        return member_predictions(fitted, d.where(F.col("fold") == f), [key, label, "fold"])

    if len(folds) < 2:
        raise ValueError("out-of-fold predictions need rows in two folds at least")
    with ThreadPool(parallelism) as pool:
        parts = pool.map(inheritable_thread_target(one), folds)
    return materialize(reduce(DataFrame.unionByName, parts))


def member_errors(oof: DataFrame, label: str, names: list[str]) -> dict[str, float]:
    """Mean squared error of each member's out-of-fold predictions, from one aggregate."""
    row = oof.agg(*[F.avg((F.col(n) - F.col(label)) ** 2).alias(n) for n in names]).first()
    return {n: row[n] for n in names}


def fit_stack(oof: DataFrame, label: str, names: list[str], alpha: float = 1.0) -> Fitted:
    """Ridge of the label on members' out-of-fold predictions (``stack`` assembles them)."""
    return fit_ridge(assemble(oof, names), label, alpha)


def nested_stacking(df: DataFrame, label: str, key: str, members: dict[str, Member], k: int = N_FOLDS,
                    alpha: float = 1.0, parallelism: int = 2) -> DataFrame:
    """D10, cross-fitted at both levels: ``key``, ``label``, ``fold``, the members' columns and
    ``prediction``, the stack's. For each outer fold the stack's weights come from predictions
    that are out of fold among the other folds' rows, and its members are fitted on those rows:
    nothing that scores a row has seen it."""
    d = stored(kfold_assign(df, key, k, "fold"), "folds")
    folds = sorted(r["fold"] for r in d.select("fold").distinct().collect())
    names = list(members)

    def one(f):
        train = d.where(F.col("fold") != f)
        inner = out_of_fold(train, label, key, members, fold_col="fold", parallelism=1)
        stack = fit_stack(inner, label, names, alpha)
        held = member_predictions(_fit_members(train, label, key, members), d.where(F.col("fold") == f), [key, label, "fold"])
        return stack.predict(assemble(held, names)).drop("features")

    with ThreadPool(parallelism) as pool:
        parts = pool.map(inheritable_thread_target(one), folds)
    return materialize(reduce(DataFrame.unionByName, parts))


def prepared_folds(df: DataFrame, label: str, features: list[str], key: str, k: int = N_FOLDS,
                   parallelism: int = 2, keep: bool = True) -> list[tuple[DataFrame, DataFrame, bool]]:
    """Per fold the training and validation matrices (features, label) and whether the model
    sees the label's log1p. Encoders and preprocessing depend on the fold alone, so models and
    parameters that are tried on the same folds share them; with ``keep`` the matrices are
    written, and the caller releases them."""
    folds = kfold_assign(df, key, k, "__cvfold")
    d, _ = _kept(df, folds)  # stays: the matrices may read it again

    def one(split):
        tr, va = split
        p = prepare(tr, label, features, key, keep)
        held = _apply(va, p.encoders, p.prep).select("features", label)
        return p.matrix, stored(held, "held") if keep else held, p.log_target

    with ThreadPool(parallelism) as pool:
        folds = pool.map(inheritable_thread_target(one), _fold_splits(d, "__cvfold", k), chunksize=1)
    return folds


_EVALUATED = ("model string, holdout_mse double, holdout_rmse double, holdout_mae double, "
              "holdout_r2 double, cv_mse_mean double, cv_mse_std double, cv_rmse_mean double, "
              "log_transformed boolean")


def _holdout_and_folds(df: DataFrame, label: str, features: list[str], key: str, models: list[str],
                       k: int, parallelism: int = 2, **overrides) -> list[dict]:
    """``_evaluate`` on the holdout split, then on each fold."""
    d, own = _kept(df, kfold_assign(holdout_split(df, key), key, k, "__cvfold"))
    holdout = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    found = _evaluate([holdout, *_fold_splits(d, "__cvfold", k)], label, features, key, models, parallelism, **overrides)
    if own:
        released(d)
    return found


def _evaluated_row(found: list[dict], model: str) -> tuple:
    (hold, log, _), *folds = _results(found, model)
    return (model, hold["mse"], hold["rmse"], hold["mae"], hold["r2"],
            *_cv_summary([r["mse"] for r, *_ in folds]), log)


def train_and_evaluate(df: DataFrame, label: str, features: list[str], key: str,
                       model: str = "gradient_boosting", k: int = N_FOLDS, save_path: str | None = None,
                       **overrides) -> DataFrame:
    """Holdout metrics of a model fitted on the 80 % part, plus k-fold CV over all rows;
    with ``save_path`` the fitted model is saved there. One row per model."""
    found = _holdout_and_folds(df, label, features, key, [model], k, keep=bool(save_path), **overrides)
    row = _evaluated_row(found, model)
    if save_path:
        save_model(*found[0][model][2], save_path)
    return df.sparkSession.createDataFrame([row], _EVALUATED)


def compare_models(df: DataFrame, label: str, features: list[str], key: str,
                   models: list[str] = tuple(MODELS), k: int = N_FOLDS, **overrides) -> DataFrame:
    """Every model's results (errors kept per model), ranked by CV MSE. The splits are
    prepared once for all models."""
    rows, errors = [], []
    found = _holdout_and_folds(df, label, features, key, list(models), k, **overrides)
    for m in models:
        try:
            rows.append(_evaluated_row(found, m))
        except Exception as e:  # noqa: BLE001 — a failing model is a result row
            errors.append((m, f"{type(e).__name__}: {e}"))
    out = None
    if rows:
        out = df.sparkSession.createDataFrame(rows, _EVALUATED).withColumn("error", F.lit(None).cast("string"))
    if errors:
        err = df.sparkSession.createDataFrame(errors, "model string, error string")
        if out is None:
            out = err.select("model", F.lit(None).cast("double").alias("cv_mse_mean"), "error")
        else:
            out = out.unionByName(err, allowMissingColumns=True)
    w = Window.orderBy(F.col("cv_mse_mean").asc_nulls_last(), "model")   # one row per model
    return out.withColumn("rank", F.row_number().over(w).cast("bigint"))


def feature_importance(df: DataFrame, label: str, features: list[str], key: str, top_n: int = 20,
                       model: str = "gradient_boosting", **overrides) -> DataFrame:
    """Top-n importances of a tree model (``random_forest`` or a boosted one)."""
    overrides = {"maxIter": 200, **overrides}
    fitted, enc, prep = fit_once(df, label, features, key, model, **overrides)
    imp = fitted.models[0].featureImportances.toArray().tolist()
    rows = sorted(zip(prep.feature_names, imp), key=lambda t: (-t[1], t[0]))[:top_n]
    return df.sparkSession.createDataFrame(
        [(i + 1, n, float(v)) for i, (n, v) in enumerate(rows)],
        "rank int, feature string, importance double")


# Search spaces of the tuner under Spark ML's names: (low, high, scale), where
# the scale is "log", "real" or the step of an integer range.
SEARCH_SPACES = {
    "ridge": {"alpha": (0.01, 100.0, "log")},
    "random_forest": {"numTrees": (100, 500, 50), "featureSubsetStrategy": (0.3, 1.0, "real"),
                      "minInstancesPerNode": (1, 20, 1), "maxDepth": (5, 30, 1)},
    "gradient_boosting": {"maxIter": (100, 1000, 50), "stepSize": (0.01, 0.2, "log"), "maxDepth": (3, 8, 1),
                          "subsamplingRate": (0.5, 1.0, "real"), "minInstancesPerNode": (1, 20, 1)},
    "lightgbm": {"maxIter": (300, 3000, 100), "stepSize": (0.01, 0.1, "log"), "maxDepth": (3, 12, 1),
                 "minInstancesPerNode": (5, 100, 1), "subsamplingRate": (0.5, 1.0, "real"),
                 "featureSubsetStrategy": (0.5, 1.0, "real")},
    "xgboost": {"maxIter": (300, 3000, 100), "stepSize": (0.01, 0.1, "log"), "maxDepth": (3, 10, 1),
                "minInstancesPerNode": (1, 20, 1), "subsamplingRate": (0.5, 1.0, "real"),
                "featureSubsetStrategy": (0.5, 1.0, "real"), "minInfoGain": (0.0, 5.0, "real")},
    "catboost": {"maxIter": (300, 3000, 100), "stepSize": (0.01, 0.1, "log"), "maxDepth": (4, 10, 1),
                 "minInstancesPerNode": (1, 50, 1)},
}


def sample_params(space: dict, rnd) -> dict:
    """One random point of a search space; a list is a choice."""
    out = {}
    for name, r in space.items():
        if isinstance(r, list):
            out[name] = rnd.choice(r)
            continue
        lo, hi, scale = r
        x = math.exp(rnd.uniform(math.log(lo), math.log(hi))) if scale == "log" else \
            rnd.uniform(lo, hi) if scale == "real" else rnd.randrange(lo, hi + 1, scale)
        out[name] = str(round(x, 4)) if name == "featureSubsetStrategy" else x
    return out


def _ridge_errors(train: DataFrame, held: DataFrame, log: bool, label: str, alphas: list[float]) -> list[float] | None:
    """MSE on ``held`` of the ridge fits (``fit_ridge``) with each alpha on ``train``. Their
    normal equations differ in the penalty alone, so one scan for the co-moments of features
    and label serves all, and one scan of the held rows scores all. None where the moments do
    not cover every row (missing labels, features without a value)."""
    p = len(train.select("features").first()["features"])
    x = train.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"))
    rows, = train.agg(F.count(F.lit(1))).first()
    cols = [f"x{i}" for i in range(p)] + ["y"]
    found = co_moments(x.select(*[F.col("x")[i].alias(f"x{i}") for i in range(p)], "y"), cols).collect()  # a row per pair
    cov, mean = np.full((p + 1, p + 1), np.nan), np.full(p + 1, np.nan)
    for r in found:
        if r["n"] == rows:
            i, j = r["i"], r["j"]
            cov[i, j] = cov[j, i] = r["cxy"]
            cov[i, i], cov[j, j], mean[i], mean[j] = r["cxx"], r["cyy"], r["mx"], r["my"]
    if not (np.isfinite(cov).all() and np.isfinite(mean).all()):
        return None
    try:
        w = np.column_stack([np.linalg.solve(cov[:p, :p] + a * np.eye(p), cov[:p, p]) for a in alphas])
    except np.linalg.LinAlgError:  # no penalty on dependent columns
        return None
    b = mean[p] - mean[:p] @ w

    def squares(batches):
        sse, n = np.zeros(len(alphas)), 0
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
            z = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), p) @ w + b
            if log:
                z = np.expm1(z)
            e = (z - y[:, None])[batch.column("y").is_valid().to_numpy(zero_copy_only=False)]
            sse, n = sse + (e * e).sum(0), n + len(e)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(alphas)), pa.int32()), pa.array([n] * len(alphas), pa.int64()), pa.array(sse)], ["i", "n", "sse"])

    y = held.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"))
    total = y.mapInArrow(squares, "i int, n bigint, sse double").groupBy("i").agg(r4(F.sum("sse") / F.nullif(F.sum("n"), F.lit(0))).alias("mse"))
    by = {r["i"]: r["mse"] for r in total.collect()}
    return [by[i] for i in range(len(alphas))]


def tune_hyperparameters(df: DataFrame, label: str, features: list[str], key: str, model: str,
                         n_trials: int = 30, k: int = N_FOLDS, seed: int = SEED,
                         space: dict | None = None, save_path: str | None = None,
                         parallelism: int = 8, **overrides) -> DataFrame:
    """Seeded random search minimising CV MSE; the best parameters are then fitted on
    the 80 % part and measured on the holdout, and saved with ``save_path``. One row per
    trial, ranked; the holdout columns are set on the best (the sequential sampler is not
    built). The folds are prepared once for all trials; a trial's fit on a fold is a set of
    Spark jobs, ``parallelism`` of them side by side. Ridge fits of all trials on a fold take
    two scans: one of the training rows' co-moments, one of the held rows."""
    import random
    rnd = random.Random(seed)
    trials = [{**overrides, **sample_params(space or SEARCH_SPACES[model], rnd)} for _ in range(n_trials)]
    path = model == "ridge" and all(set(t) == {"alpha"} for t in trials)
    df, own = _kept(df, df)
    folds = prepared_folds(df, label, features, key, k, min(k, parallelism), keep=not path)

    def one(task):
        params, (train, held, log) = task
        fitted = fit_model(model, train, label, **params)
        p = fitted.predict(held)
        if log:
            p = p.withColumn("prediction", F.expm1("prediction"))
        return regression_metrics(p.withColumn("prediction", clip("prediction", *CLIP)), label).first()["mse"]

    def all_alphas(fold):
        found = _ridge_errors(*fold, label, [t["alpha"] for t in trials])
        return found if found is not None else [one((t, fold)) for t in trials]

    with ThreadPool(parallelism) as pool:
        if path:
            by_fold = pool.map(inheritable_thread_target(all_alphas), folds, chunksize=1)
            mse = [by_fold[f][i] for i in range(n_trials) for f in range(k)]
        else:
            mse = pool.map(inheritable_thread_target(one), [(t, f) for t in trials for f in folds], chunksize=1)
    for train, held, _ in folds:
        released(train)
        released(held)
    means = [sum(mse[i * k : (i + 1) * k]) / k for i in range(n_trials)]
    rows = [(i, json.dumps(t, sort_keys=True), m, math.sqrt(m)) for i, (t, m) in enumerate(zip(trials, means))]
    best = min(rows, key=lambda r: (r[2], r[0]))[0]
    d = holdout_split(df, key)
    fitted, enc, prep = fit_once(d.where(F.col("split") == "train"), label, features, key, model, **trials[best])
    hold = regression_metrics(predict_with(fitted, enc, prep, d.where(F.col("split") == "test")), label).first()
    if save_path:
        save_model(fitted, enc, prep, save_path)
    if own:
        released(df)
    out = df.sparkSession.createDataFrame(
        [(*r, hold["mse"] if r[0] == best else None, hold["r2"] if r[0] == best else None) for r in rows],
        "trial int, params string, cv_mse_mean double, cv_rmse_mean double, holdout_mse double, holdout_r2 double")
    w = Window.orderBy("cv_mse_mean", "trial")   # one row per trial
    return out.withColumn("rank", F.row_number().over(w).cast("bigint"))


def batch_score(train: DataFrame, test: DataFrame, label: str, features: list[str], key: str,
                model: str = "gradient_boosting", **overrides) -> DataFrame:
    """Fit on all training rows, score the test table (expm1 + clip)."""
    fitted, enc, prep = fit_once(train, label, features, key, model, **overrides)
    return predict_with(fitted, enc, prep, test)


# ---------------------------------------------------------------------------
# persistence
# ---------------------------------------------------------------------------

def save_model(fitted: Fitted, enc, prep: Prep, path: str) -> None:
    """Spark ML models via their writers; encoders and preprocessing as
    parquet tables plus one JSON metadata file written through Spark."""
    spark = prep_spark(prep, enc)
    for i, m in enumerate(fitted.models):
        if m is not None:
            m.write().overwrite().save(os.path.join(path, f"model_{i}"))
    for c, t in prep.codes.items():
        t.write.mode("overwrite").parquet(os.path.join(path, f"codes_{c}"))
    for i, e in enumerate(enc):
        e.table.write.mode("overwrite").parquet(os.path.join(path, f"te_{i}"))
        e.global_mean.write.mode("overwrite").parquet(os.path.join(path, f"te_gm_{i}"))
    meta = {"kind": fitted.kind, "const": fitted.const, "log_target": fitted.log_target,
            "n_models": len(fitted.models), "model_types": [type(m).__name__ if m is not None else None
                                                           for m in fitted.models],
            "numeric": prep.numeric, "categorical": prep.categorical, "medians": prep.medians,
            "means": prep.means, "stds": prep.stds, "modes": prep.modes,
            "encoders": [e.cat for e in enc]}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(
        "overwrite").text(os.path.join(path, "meta"))


def prep_spark(prep: Prep, enc):
    for t in list(prep.codes.values()) + [e.table for e in enc]:
        return t.sparkSession
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def load_model(spark, path: str):
    """Inverse of ``save_model``."""
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.ml.regression import (GBTRegressionModel, LinearRegressionModel,
                                       RandomForestRegressionModel)
    meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
    readers = {"LinearRegressionModel": LinearRegressionModel,
               "RandomForestRegressionModel": RandomForestRegressionModel,
               "GBTRegressionModel": GBTRegressionModel,
               "GBTClassificationModel": GBTClassificationModel}
    models = [readers[t].load(os.path.join(path, f"model_{i}")) if t else None
              for i, t in enumerate(meta["model_types"])]
    codes = {c: bounded_broadcast(spark.read.parquet(os.path.join(path, f"codes_{c}")))
             for c in meta["categorical"]}
    prep = Prep(meta["numeric"], meta["categorical"], meta["medians"], meta["means"], meta["stds"],
                meta["modes"], codes)
    enc = [FE.TargetEncoding(c, bounded_broadcast(spark.read.parquet(os.path.join(path, f"te_{i}"))),
                             spark.read.parquet(os.path.join(path, f"te_gm_{i}")), c)
           for i, c in enumerate(meta["encoders"])]
    fitted = Fitted(meta["kind"], models, meta["const"], meta["log_target"])
    return fitted, enc, prep


def evaluate_saved_model(spark, path: str, df: DataFrame, label: str, key: str) -> DataFrame:
    """Load, re-split with the same hash, score the holdout, metrics."""
    fitted, enc, prep = load_model(spark, path)
    test = holdout_split(df, key).where(F.col("split") == "test")
    return regression_metrics(predict_with(fitted, enc, prep, test), label)


# ---------------------------------------------------------------------------
# Predictions sink
# ---------------------------------------------------------------------------

# Id column names looked for in the scoring table, in order.
ID_CANDIDATES = ["id", "Id", "ID", "index"]


def predictions_frame(scored: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """``(id, prediction)``; the id is the first of id/Id/ID/index present,
    otherwise a 0-based row number over an explicit order."""
    idc = next((c for c in ID_CANDIDATES if c in scored.columns), None)
    if idc:
        return scored.select(F.col(idc), "prediction")
    from tablekit.functions.joins import dense_index
    order = order_by or [c for c in scored.columns if c != "prediction"][:1]
    # only what is ordered by moves with the predictions
    narrow = scored.select(*dict.fromkeys([*order, "prediction"]))
    return dense_index(narrow, order, "id").select("id", "prediction")


def write_predictions(scored: DataFrame, path: str, fmt: str = "csv",
                      order_by: list[str] | None = None) -> None:
    out = predictions_frame(scored, order_by)
    w = out.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


# ---------------------------------------------------------------------------
# Review rules and report tables (over a results table)
# ---------------------------------------------------------------------------

def review_model_results(results: DataFrame, pct_zero: float | None = None,
                         holdout_col: str = "holdout_rmse") -> DataFrame:
    """The fixed checklist over results ``(model, cv_rmse_mean[, holdout_rmse])``:
    overfit (holdout RMSE > 1.2 × CV RMSE), zero-inflation without a suitable
    model, a single model tried, RMSE > 80 poor / < 40 good."""
    has_hold = holdout_col in results.columns
    n_models = results.agg(F.count_distinct("model").alias("__nm"))
    r = results.crossJoin(F.broadcast(n_models))
    rm = F.col("cv_rmse_mean")
    checks = [
        ("overfit", "major", (F.col(holdout_col) > 1.2 * rm) if has_hold else F.lit(False)),
        ("zero_inflation_unhandled", "major",
         F.lit(pct_zero is not None and pct_zero > ZERO_INFLATION)
         & ~F.col("model").isin("two_stage", "ensemble")),
        ("single_model_tried", "minor", F.col("__nm") == 1),
        ("poor_rmse", "major", rm > 80),
        ("good_rmse", "ok", rm < 40),
    ]
    structs = [F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), c.alias("hit"))
               for n, s, c in checks]
    return (r.select("model", "cv_rmse_mean", F.explode(F.array(*structs)).alias("c"))
             .where("c.hit").select("model", "c.check", "c.severity"))


def review_feature_decisions(d: FE.FeatureDecisions, leakage: DataFrame, high_card: DataFrame,
                             pct_zero: DataFrame, date_columns: list[str] = ()) -> DataFrame:
    """Leakage suspects not dropped; > 10 distinct not encoded; zeros >
    15 % without the two-stage flag; date columns left unconverted."""
    spark = leakage.sparkSession
    drops = spark.createDataFrame([(c,) for c in d.drop_columns], "column_name string")
    enc = spark.createDataFrame([(c,) for c in d.encode_columns], "column_name string")
    a = (leakage.select("column_name").distinct().join(F.broadcast(drops), "column_name", "left_anti")
         .select(F.lit("leakage_not_dropped").alias("issue"), "column_name"))
    b = (high_card.select("column_name").join(F.broadcast(enc), "column_name", "left_anti")
         .join(F.broadcast(drops), "column_name", "left_anti")
         .select(F.lit("high_cardinality_not_encoded").alias("issue"), "column_name"))
    c = (pct_zero.where((F.col("pct_zero") > ZERO_INFLATION) & F.lit(not d.two_stage_recommended))
         .select(F.lit("two_stage_not_flagged").alias("issue"), F.lit(None).cast("string").alias("column_name")))
    dd = spark.createDataFrame([("date_not_converted", c) for c in date_columns
                                if c not in d.drop_columns], "issue string, column_name string")
    return a.unionByName(b).unionByName(c).unionByName(dd)


def comparison_table(results: DataFrame) -> DataFrame:
    """Model comparison with RMSE = sqrt(MSE) at 2 decimals, ranked."""
    w = Window.orderBy(F.col("cv_mse_mean").asc_nulls_last(), "model")   # one row per model
    return results.select(
        F.row_number().over(w).cast("bigint").alias("rank"), "model",
        F.round("cv_mse_mean", 2).alias("cv_mse"), F.round(F.sqrt("cv_mse_mean"), 2).alias("cv_rmse"))
