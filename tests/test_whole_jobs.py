"""Registered modelling queries run the operators' whole jobs."""

import os

import pytest
from pyspark.sql import functions as F

from tablekit.operators import model as M
from tablekit.plans import model_queries as Q


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"k{i}", float(i % 7) + 0.1 * (i % 3), float(i % 7), "xyz"[i % 3], f"b{i % 12}") for i in range(120)]
    return spark.createDataFrame(rows, "row_key string, target double, a double, c string, p_brand string").repartition(2)


@pytest.fixture
def given(table, monkeypatch):
    monkeypatch.setattr(Q, "_model_table", lambda s, d: table)
    return table


def test_boosted_variants_run_their_own_settings(spark, given, monkeypatch):
    seen, whole = {}, M.fit_gbt
    monkeypatch.setattr(M, "fit_gbt", lambda df, label, profile, **own: (seen.update({profile: own}), whole(df, label, profile, maxIter=1, maxDepth=1))[1])
    assert {r["model"] for r in Q.QUERIES["fit_boosted_variants"](spark, "").collect()} == set(M.BOOSTED)
    assert seen == {m: {} for m in M.BOOSTED}


def test_classifier_runs_its_own_settings(spark, monkeypatch):
    z = spark.createDataFrame([(i, float(i % 3 == 0), i % 24, i % 7, i % 5, i % 11) for i in range(60)], "event_id long, target double, hour int, dow int, k int, user_id int")
    monkeypatch.setattr(Q.V, "zero_view", lambda s, d: z)
    seen, whole = [], M.fit_classifier
    monkeypatch.setattr(M, "fit_classifier", lambda df, label, **own: (seen.append(own), whole(df, label, maxIter=1, maxDepth=1))[1])
    assert Q.QUERIES["fit_classifier"](spark, "").first()["n"] == 60 and seen == [{}]


def test_training_runs_the_models_own_settings(spark, given, monkeypatch):
    seen, whole = [], M.fit_gbt
    monkeypatch.setattr(M, "fit_gbt", lambda df, label, profile, **own: (seen.append((profile, own)), whole(df, label, profile, maxIter=1, maxDepth=1))[1])
    assert Q.QUERIES["train_and_evaluate"](spark, "").first()["model"] == "gradient_boosting"
    assert seen == [("gradient_boosting", {})] * 6  # the holdout split and five folds


def test_all_models_are_compared_at_their_own_settings(spark, given, monkeypatch):
    seen, whole = [], M.fit_ridge
    monkeypatch.setattr(M, "fit_model", lambda name, df, label, **own: (seen.append((name, own.keys() - {"known"})), whole(df, label))[1])
    out = Q.QUERIES["compare_models"](spark, "").collect()
    assert {r["model"] for r in out} == set(M.MODELS) and {r["error"] for r in out} == {None}
    assert sorted(n for n, _ in seen) == sorted(M.MODELS * 6) and not any(own for _, own in seen)


def test_ensemble_takes_the_members_already_fitted(table):
    d = M.prepare(table, "target", ["a", "c"], "row_key").matrix
    quick = {"maxIter": 2, "maxDepth": 2}
    known = {m: M.fit_gbt(d, "target", m, **quick) for m in M.BOOSTED[:2]}
    one, two = M.fit_ensemble(d, "target", **quick), M.fit_ensemble(d, "target", known=known, **quick)
    assert two.models[:2] == [known[m].models[0] for m in M.BOOSTED[:2]]
    assert [r["prediction"] for r in one.predict(d).collect()] == [r["prediction"] for r in two.predict(d).collect()]


def test_saved_model_is_that_of_the_holdout_split(spark, table):
    from tablekit.session import scratch_path
    path = scratch_path(spark, "model")
    row = M.train_and_evaluate(table, "target", ["a", "c"], "row_key", "gradient_boosting", 3, path, maxIter=2, maxDepth=2).first()
    assert M.evaluate_saved_model(spark, path, table, "target", "row_key").first()["mse"] == row["holdout_mse"]


def test_encode_and_log_gives_both_tables_with_all_columns(spark, given):
    out = Q.QUERIES["encode_and_log"](spark, "")
    assert out.columns == ["row_key", "target", "a", "c", "p_brand", "split", "log_applied"]
    train, test = (out.where(F.col("split") == x).collect() for x in ("train", "test"))
    assert len(train) == len(test) == given.count() and {r["target"] for r in test} == {None}
    gm = given.agg(F.avg("target")).first()[0]
    mean = {r["p_brand"]: (r["s"] + 20 * gm) / (r["n"] + 20) for r in given.groupBy("p_brand").agg(F.sum("target").alias("s"), F.count("target").alias("n")).collect()}
    key = {r["row_key"]: r["p_brand"] for r in given.collect()}
    assert all(r["p_brand"] == pytest.approx(mean[key[r["row_key"]]]) for r in test)  # all rows' statistics
    assert any(r["p_brand"] != pytest.approx(mean[key[r["row_key"]]]) for r in train)  # out of fold
    assert {r["c"] for r in test} == {"x", "y", "z"}


def test_large_matrix_is_read_in_tasks_of_so_many_rows(spark, table, monkeypatch):
    monkeypatch.setattr(M, "TASK_ROWS", 30)
    put = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}  # small files go together
    before = {k: spark.conf.get(k, None) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    try:
        seen, whole = [], M.dealt
        monkeypatch.setattr(M, "dealt", lambda df: (seen.append((df, df.rdd.getNumPartitions())), whole(df))[1])
        p = M.prepare(table.coalesce(1), "target", ["a", "c"], "row_key")
        assert p.matrix.rdd.getNumPartitions() == 1
        M.fit_gbt(p.matrix, "target", maxIter=1, maxDepth=1)
        M.fit_random_forest(p.matrix, "target", numTrees=1, maxDepth=1)
        M.fit_classifier(p.matrix, "target", maxIter=1, maxDepth=1)
        assert [n for _, n in seen] == [4, 4, 4]  # a file of 30 rows each, no shuffle
        assert spark.conf.get("spark.sql.files.openCostInBytes") == "0"
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_small_matrix_keeps_its_partitions(table, monkeypatch):
    p = M.prepare(table, "target", ["a", "c"], "row_key")
    assert p.matrix.storageLevel.useMemory and p.matrix.rdd.getNumPartitions() == 2
    monkeypatch.setattr(M, "file_a_task", None)  # not asked for
    M.fit_gbt(p.matrix, "target", maxIter=1, maxDepth=1)


def test_written_matrices_are_deleted_behind_their_fits(table, monkeypatch):
    made, whole = [], M.stored
    monkeypatch.setattr(M, "TASK_ROWS", 5)
    monkeypatch.setattr(M, "stored", lambda *a: (made.append(whole(*a)), made[-1])[1])
    M.cross_validate(table, "target", ["a", "c"], "row_key", "gradient_boosting", 3, maxIter=1, maxDepth=1)
    paths = [t._stored_at for t in made]
    assert len(paths) == 4 and not any(os.path.exists(p) for p in paths)  # the folds and three matrices
