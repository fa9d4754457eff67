"""Intermediate shuffles and tables leave the disk when they are done with."""

import math
import os
import time
from threading import Thread

from pyspark.sql import functions as F

from tablekit.functions.joins import released, stored
from tablekit.llm.store import written
from tablekit.operators import retrieve as R
from tablekit.session import held_setting

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffles(spark) -> int:
    """Shuffle files of the session's local folders."""
    roots = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return sum(f.startswith("shuffle_") and f.endswith(".data") for r in roots for _, _, fs in os.walk(r) for f in fs)


def test_a_written_tables_shuffle_is_deleted_at_once(spark):
    for write in (stored, written):
        before = _shuffles(spark)
        out = write(spark.range(1000).repartition(4, "id"), "some")
        for _ in range(50):  # deleted by another thread
            if _shuffles(spark) <= before:
                break
            time.sleep(0.1)
        assert _shuffles(spark) <= before and out.count() == 1000
    assert spark.conf.get(FREED) == "false"


def test_released_table_is_deleted(spark):
    t = stored(spark.range(10), "some")
    assert os.path.exists(t._stored_at)
    released(t)
    assert not os.path.exists(t._stored_at)


def test_setting_is_held_until_the_last_thread_lets_it_go(spark):
    def hold(s):
        with held_setting(spark, FREED, "true"):
            time.sleep(s)
            assert spark.conf.get(FREED) == "true"

    threads = [Thread(target=hold, args=(s,)) for s in (0.1, 0.5)]
    for t in threads:
        t.start()
    time.sleep(0.3)
    assert spark.conf.get(FREED) == "true"
    for t in threads:
        t.join()
    assert spark.conf.get(FREED) == "false"


def test_frequencies_and_norms_in_slices_of_the_vocabulary(spark, monkeypatch):
    rows = [(c, f"t{c * i % 13}" if i else None, 1 + i % 3) for c in range(20) for i in range(6)]
    post = stored(spark.createDataFrame(rows, "chunk_id long, term string, tf int").where("term is not null").groupBy("chunk_id", "term").agg(F.sum("tf").alias("tf")), "post")
    terms = stored(spark.createDataFrame([(f"t{i}", 0.5 + i) for i in range(11)], "term string, idf double"), "terms")
    monkeypatch.setattr(R, "SLICE_POSTINGS", 10)
    assert len(R._term_slices(post)) == R.TERM_SLICES
    path = post._stored_at + "-df"
    df = {r.term: r.df for r in R.write_frequencies(post, path).collect()}
    idf = {r.term: r.idf for r in terms.collect()}
    want, squares = {}, {}
    for r in post.collect():
        want[r.term] = want.get(r.term, 0) + 1
        if r.term in idf:
            squares[r.chunk_id] = squares.get(r.chunk_id, 0.0) + ((1 + math.log(r.tf)) * idf[r.term]) ** 2
    assert df == want
    got = {r.chunk_id: r.norm for r in R.sliced_norms(post, terms, ["chunk_id"]).collect()}
    assert got.keys() == squares.keys() and all(math.isclose(got[c], math.sqrt(s)) for c, s in squares.items())
