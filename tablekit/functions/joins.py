"""Join and ranking helpers that keep the plan distributed.

* ``bounded_broadcast``: broadcast a side only after its size is
  checked against a bound in bytes; otherwise the join stays a shuffle join and AQE's
  skew-join splitting handles hot keys.
* ``dense_index``: consecutive 0-based positions over a global order without
  an unpartitioned window — range-partition, number rows inside each
  partition, add the partition's offset (a table with one row per partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_MAX_BYTES = 64 << 20


def materialize(df: DataFrame) -> DataFrame:
    """Write a table that several later plans read once to the shared
    checkpoint folder (``spark.checkpoint.dir``) and read it back: cuts the
    lineage (survives executor loss) and stops each reader from recomputing it."""
    from tablekit.session import checkpoint_dir, shuffles_freed
    checkpoint_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own


def stored(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """As ``materialize``, for large tables: compressed Parquet, of which each reader takes the
    columns it needs, where a checkpoint holds whole rows as they are in memory. ``file_rows``:
    rows of a file at most (0: any number)."""
    from tablekit.session import scratch_path, shuffles_freed
    path = scratch_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def released(df: DataFrame) -> None:
    """Delete a table made by ``stored`` that nothing reads any more; unpersist any other."""
    path = getattr(df, "_stored_at", None)
    if path is None:
        df.unpersist()
        return
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def bounded_broadcast(small: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``small`` (an aggregate) only when its rows, once computed, take no more
    than ``max_bytes``; otherwise the join stays a shuffle join."""
    small = materialize(small)
    size = F.sum(sum([F.octet_length(F.to_json(F.struct(F.col(f"`{c}`")))) for c in small.columns], F.lit(0)))
    return F.broadcast(small) if (small.agg(size.alias("n")).first()["n"] or 0) <= max_bytes else small


def dense_index(df: DataFrame, order_cols: list[str], name: str = "idx",
                partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0..n-1 following ``order_cols`` (ascending, NULLs first).

    Ties keep an arbitrary but fixed order only when ``order_cols`` is unique;
    callers pass a unique key.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written once: both readers (counts, numbering) see the same partition ids
    ranged = materialize(df.repartitionByRange(n, *order_cols)
                           .withColumn("__pid", F.spark_partition_id()))
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition: the running offset is computed on #partitions rows
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    local = F.row_number().over(Window.partitionBy("__pid").orderBy(*order_cols))
    return (ranged.withColumn("__local", local)
                  .join(F.broadcast(offsets), "__pid")
                  .withColumn(name, (F.col("__off") + F.col("__local") - 1).cast("bigint"))
                  .drop("__pid", "__local", "__off"))


def group_positions(df: DataFrame, group_cols: list[str], order_cols: list[str],
                    name: str = "pos", partitions: int | None = None) -> DataFrame:
    """0-based position of each row inside its group following ``order_cols``
    (unique within a group), without a window over a whole group.

    The rows are range-partitioned on (group, order) — a hot group is spread
    over many partitions by its order values — numbered inside each
    (partition, group), and shifted by the rows of the same group in earlier
    partitions (a table with one row per (partition, group))."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = list(group_cols)
    ranged = materialize(df.repartitionByRange(n, *g, *order_cols)
                           .withColumn("__pid", F.spark_partition_id()))
    counts = ranged.groupBy("__pid", *g).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*g).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", *g, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    local = F.row_number().over(Window.partitionBy("__pid", *g).orderBy(*order_cols))
    return (ranged.withColumn("__local", local)
                  .join(offsets, ["__pid", *g])      # one row per (partition, group)
                  .withColumn(name, (F.col("__off") + F.col("__local") - 1).cast("bigint"))
                  .drop("__pid", "__local", "__off"))


def running_min(df: DataFrame, group_cols: list[str], order_cols: list[str], col: str, name: str,
                partitions: int | None = None) -> DataFrame:
    """Least ``col`` among a row and those before it in its group (``order_cols`` unique within
    a group; null values are passed over). As in ``group_positions`` a group is spread over
    partitions by its order values: each takes the running minimum of its own rows, lowered
    by the least of the group's earlier partitions (one row per partition and group)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = list(group_cols)
    ranged = materialize(df.repartitionByRange(n, *g, *order_cols).withColumn("__pid", F.spark_partition_id()))
    least = ranged.groupBy("__pid", *g).agg(F.min(col).alias("__least"))
    before = Window.partitionBy(*g).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = least.select("__pid", *[F.col(c).alias(f"__g{i}") for i, c in enumerate(g)], F.min("__least").over(before).alias("__carry"))
    same = F.col("r.__pid") == F.col("c.__pid")
    for i, c in enumerate(g):
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"c.__g{i}"))
    local = Window.partitionBy("__pid", *g).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ranged.withColumn("__own", F.min(col).over(local))
    return (own.alias("r").join(carry.alias("c"), same)
               .select(*[F.col(f"r.{c}") for c in df.columns], F.least("__own", "__carry").alias(name)))
