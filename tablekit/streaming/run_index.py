"""The run index maintained incrementally from a directory of event files.

``readStream.json`` → ``foreachBatch``: the batch's events go to an append-only store
(one folder per epoch, partitioned by a hash of the run), the runs it touches are counted
anew from the store, each event id once, and replace their rows in the next version of the
index. Nothing is bounded by event time, so an event counts however late it comes, and a
copy never counts twice. A retried epoch writes the same folder and version again from the
newest version before it, so the sink is idempotent.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekit.operators.events import run_summary
from tablekit.sources.io import EVENT_SCHEMA, JSON_TS

RUN_BUCKETS = 64


def _version_path(index_dir: str, epoch: int) -> str:
    return os.path.join(index_dir, f"v={epoch:012d}")


def _committed(spark: SparkSession, index_dir: str) -> list[int]:
    """Epochs of the committed versions, in order; none if there is no index yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(index_dir)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(
        jvm.org.apache.hadoop.fs.Path(os.path.join(index_dir, n, "_SUCCESS"))))


def latest_index(spark: SparkSession, index_dir: str, before: int | None = None) -> DataFrame | None:
    """The newest committed version of the index table, or the newest one before an epoch;
    None if there is none."""
    done = [e for e in _committed(spark, index_dir) if before is None or e < before]
    return spark.read.parquet(_version_path(index_dir, done[-1])) if done else None


def distinct_events(events: DataFrame) -> DataFrame:
    """Each event id once; events without an id each count."""
    return events.where("event_id is not null").dropDuplicates(["event_id"]).unionByName(
        events.where("event_id is null"))


def merge_batch(batch: DataFrame, epoch: int, index_dir: str) -> None:
    """Add one batch of events to the store and write the index version of its epoch."""
    spark = batch.sparkSession
    store = os.path.join(index_dir, "events")
    bucket = F.pmod(F.xxhash64("run_id"), F.lit(RUN_BUCKETS)).cast("int")
    batch.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(
        os.path.join(store, f"epoch={epoch:012d}"))
    kept = spark.read.schema(f"{EVENT_SCHEMA}, epoch bigint, bucket int").parquet(store).where(F.col("epoch") <= epoch)
    touched = kept.where(F.col("epoch") == epoch).select("run_id", "bucket").distinct()
    again = run_summary(distinct_events(kept.join(touched, ["run_id", "bucket"], "left_semi").drop("epoch", "bucket")))
    before = latest_index(spark, index_dir, epoch)
    out = again if before is None else before.join(touched.select("run_id"), "run_id", "left_anti").unionByName(again)
    out.write.mode("overwrite").parquet(_version_path(index_dir, epoch))


def start_run_index_stream(spark: SparkSession, events_dir: str, index_dir: str, checkpoint: str,
                           available_now: bool = True):
    """Start the incremental index; returns the StreamingQuery."""
    events = (spark.readStream.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED")
                   .option("timestampFormat", JSON_TS).option("recursiveFileLookup", "true")
                   .json(events_dir))
    w = (events.writeStream.foreachBatch(lambda batch, epoch: merge_batch(batch, epoch, index_dir))
               .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
