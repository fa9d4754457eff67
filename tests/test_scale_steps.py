"""Steps that are read many times are written once; terms are counted without a shuffle."""

from collections import Counter

from pyspark.sql import functions as F

from tablekit.operators import model as M
from tablekit.operators import segments as S
from tablekit.plans import model_queries as MQ


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_counted_in_place(spark, tmp_path, monkeypatch):
    plans = {}
    write = S._written
    monkeypatch.setattr(S, "_written", lambda df, path: (plans.__setitem__(path.rsplit("/", 1)[1], plan_of(df)), write(df, path)))
    rows = [(1, "A b a b a", "s", ["en", None, "en"]), (2, None, "s", None), (3, "", "s", []), (4, "é é_1 x", "s", ["en"]), (None, "a b", "s", ["fr"])]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, text string, source string, tags array<string>")
    index = S.SegmentedIndex.build(chunks, str(tmp_path / "index"))
    assert "Exchange" not in plans["postings"] and "Aggregate" not in plans["postings"]
    got = {(r["chunk_id"], r["term"]): r["tf"] for r in index.postings.join(index.docs, ["bucket", "pos"]).collect()}
    want = Counter()
    for i, k, w, g in [(1, "a b a b a", "", "en"), (4, "_1 x", "é_1", "en"), (None, "a b", "", "fr")]:
        want.update([(i, "k" + t) for t in k.split()] + [(i, "w" + t) for t in w.split()] + [(i, "g" + g)])
    assert got == dict(want)
    words = spark.createDataFrame([(7, "the cat the cat sat", "s", ["en"])], chunks.schema)
    index = S.SegmentedIndex.build(words, str(tmp_path / "words"), use_bm25=False)
    got = {r["term"]: r["tf"] for r in index.postings.collect()}
    assert got == {"wthe": 2, "wcat": 2, "wsat": 1, "wthe cat": 2, "wcat the": 1, "wcat sat": 1, "gen": 1}


def test_model_table_is_written(spark, sf_small):
    df = MQ._model_table(spark, sf_small)
    assert "Join" not in plan_of(df) and "InMemoryTableScan" not in plan_of(df)


def test_folds_are_written(spark, monkeypatch):
    seen = []
    fit = M._fit_members
    monkeypatch.setattr(M, "_fit_members", lambda train, *a: (seen.append(plan_of(train)), fit(train, *a))[1])
    rows = spark.range(60).select(F.concat(F.lit("r"), "id").alias("key"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") * 1.5).alias("y"))
    out = M.out_of_fold(rows, "y", "key", {"m": M.Member("ridge", ["x"])}, k=2)
    assert out.count() == 60 and all("InMemoryTableScan" not in p for p in seen)


def test_predictions_move_without_other_columns(spark):
    scored = spark.range(9).select(F.col("id").alias("key"), F.lit("wide").alias("other"), (F.col("id") * 2.0).alias("prediction"))
    out = M.predictions_frame(scored, ["key"])
    assert "other" not in plan_of(out)
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(i, i * 2.0) for i in range(9)]
