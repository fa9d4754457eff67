"""Intermediate tables in the folder the cluster shares.

``spark.checkpoint.dir`` names it. Only a local master without that setting (tests)
gets a folder of its own; on a cluster the setting is required.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tablekit.session import shuffles_freed

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="llm-shared-", dir="/tmp")
    return _LOCAL[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once and read it back: cuts its lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_freed(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no returned frame reads."""
    for t in tables:
        path = getattr(t, "_llm_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan with fewer splits than task slots (one row group, one file) out evenly."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
