"""Out-of-fold tables, weighted and stacked ensembles against plain ridge regressions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekit.operators import extras as X
from tablekit.operators import model as M

K = 3


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(8)
    n = 150
    x = r.normal(size=(n, 3))
    y = x @ [2.0, -1.0, 0.5] + r.normal(size=n) * 0.3
    rows = [(f"k{i // 2}", *map(float, x[i]), float(y[i])) for i in range(n)]      # keys repeat
    return rows, spark.createDataFrame(rows, "key string, a double, b double, c double, y double").repartition(3)


MEMBERS = {"first": M.Member("ridge", ["a", "b"], {"alpha": 2.0}), "last": M.Member("ridge", ["b", "c"])}


def fold(key):
    return int(hashlib.md5(f"cv-{key}".encode()).hexdigest()[:8], 16) % K


def ridge(x, y, alpha):
    mx, my = x.mean(0), y.mean()
    w = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return lambda z: (z - mx) @ w + my


def member(x, y, alpha):
    mean, sd = x.mean(0), x.std(0)
    f = ridge((x - mean) / sd, y, alpha)
    return lambda z: f((z - mean) / sd)


def plain(rows):
    x, y = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    return np.array([fold(r[0]) for r in rows]), {"first": x[:, :2], "last": x[:, 1:]}, y


def plain_oof(f, xs, y, alphas):
    out = {n: np.zeros(len(y)) for n in xs}
    for n, x in xs.items():
        for g in set(f):
            out[n][f == g] = member(x[f != g], y[f != g], alphas[n])(x[f == g])
    return out


ALPHAS = {"first": 2.0, "last": M.RIDGE_ALPHA}


def rows_of(df, names):
    return sorted((r["key"], round(r["y"], 9), r["fold"], *[round(r[n], 6) for n in names]) for r in df.collect())


def test_each_row_is_scored_by_the_model_that_did_not_see_it(table):
    rows, df = table
    f, xs, y = plain(rows)
    want = plain_oof(f, xs, y, ALPHAS)
    oof = M.out_of_fold(df, "y", "key", MEMBERS, K)
    expected = sorted((r[0], round(r[4], 9), int(f[i]), *[round(want[n][i], 6) for n in MEMBERS]) for i, r in enumerate(rows))
    assert rows_of(oof, MEMBERS) == [pytest.approx(e, abs=2e-6) for e in expected]
    errors = M.member_errors(oof, "y", list(MEMBERS))
    assert errors == pytest.approx({n: ((want[n] - y) ** 2).mean() for n in MEMBERS})
    weighted = X.weighted_ensemble(oof, list(errors), list(errors.values()))
    w = np.array([1 / errors[n] for n in MEMBERS])
    both = w[0] / w.sum() * want["first"] + w[1] / w.sum() * want["last"]
    assert sorted(r["prediction"] for r in weighted.collect()) == pytest.approx(sorted(both), abs=1e-6)


def test_stack_weights_and_nested_predictions(table):
    rows, df = table
    f, xs, y = plain(rows)
    oof = M.out_of_fold(df, "y", "key", MEMBERS, K)
    z = np.column_stack(list(plain_oof(f, xs, y, ALPHAS).values()))
    got = {r["member"]: r["weight"] for r in X.stacking(oof, list(MEMBERS), "y").collect()}
    at = ridge(z, y, 1.0)
    w = [at(z.mean(0) + e) - y.mean() for e in np.eye(2)]
    assert [got["first"], got["last"]] == pytest.approx(w, abs=1e-6)
    assert got["intercept"] == pytest.approx(float(at(np.zeros(2))), abs=1e-6)

    nested = M.nested_stacking(df, "y", "key", MEMBERS, K)
    want = np.zeros(len(y))
    for g in set(f):
        seen = f != g
        inner = plain_oof(f[seen], {n: x[seen] for n, x in xs.items()}, y[seen], ALPHAS)
        stack = ridge(np.column_stack(list(inner.values())), y[seen], 1.0)
        want[~seen] = stack(np.column_stack([member(x[seen], y[seen], ALPHAS[n])(x[~seen]) for n, x in xs.items()]))
    expected = sorted((r[0], round(r[4], 9), int(f[i]), round(want[i], 6)) for i, r in enumerate(rows))
    assert rows_of(nested, ["prediction"]) == [pytest.approx(e, abs=2e-6) for e in expected]


def test_one_fold_is_refused(table):
    with pytest.raises(ValueError, match="two folds"):
        M.out_of_fold(table[1].withColumn("one", F.lit(0)), "y", "key", MEMBERS, fold_col="one")


def test_trees_and_categories_are_members_too(spark, table):
    df = table[1].withColumn("kind", F.when(F.col("a") > 0, "x").otherwise("z"))
    members = {"forest": M.Member("random_forest", ["a", "kind"], {"numTrees": 5, "maxDepth": 3}), "line": MEMBERS["last"]}
    oof = M.out_of_fold(df, "y", "key", members, K)
    assert oof.count() == 150 and oof.columns == ["key", "y", "fold", "forest", "line"]
    line = M.out_of_fold(df, "y", "key", {"line": MEMBERS["last"]}, K)
    assert rows_of(oof, ["line"]) == rows_of(line, ["line"])
