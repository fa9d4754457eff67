"""Session construction and table loading.

The session settings are the ones a cluster job wants as well: AQE on (runtime
coalescing, skew-join splitting, broadcast conversion from real sizes), UTC
session time zone (timestamps compare equal to the SQL oracle), no web UI.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def get_session(master: str | None = None, app: str = "tablekit",
                shuffle_partitions: int | None = None,
                conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables: ``spark.checkpoint.dir``.

    Only a local master without that setting (tests, scripts) gets a folder of its own,
    one per application; on a cluster the setting is required.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
        if sc.applicationId not in _LOCAL_DIRS:
            _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="tablekit-", dir="/tmp")
        path = _LOCAL_DIRS[sc.applicationId]
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path


_HELD: dict[str, list] = {}  # setting -> [users, value before]
_HELD_LOCK = Lock()


@contextmanager
def held_setting(spark: SparkSession, key: str, value: str):
    """A setting of the session while any thread holds it."""
    with _HELD_LOCK:
        held = _HELD.setdefault(key, [0, spark.conf.get(key)])
        held[0] += 1
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _HELD_LOCK:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(key, _HELD.pop(key)[1])


def shuffles_freed(spark: SparkSession):
    """While it is held, a job's shuffle files are deleted at its end, not when the driver's
    garbage collector comes to them: for writes, whose shuffles nothing reads again."""
    return held_setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def file_a_task(spark: SparkSession):
    """While it is held, scans planned in the session read one file in a task at most (else
    small files are put together by their bytes, however many rows these hold)."""
    # a file's cost fills a task's share
    return held_setting(spark, "spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def spread_narrow(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer splits than the cluster has task
    slots (e.g. a file written as a single row group) so the first stage runs
    in parallel. Planning only, no job; a no-op for large, many-split inputs."""
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots)
    return df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spread_narrow(spark.read.parquet(path))


def load_tables(spark: SparkSession, sf_dir: str,
                names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    return {n: read_parquet(spark, os.path.join(sf_dir, f"{n}.parquet")) for n in names}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, os.path.join(sf_dir, f"{name}.parquet"))
