"""Centroid clustering (operator 11) with an incremental distance matrix.

Every vector carries its exact integer dot products with all centroids, one row of the
distance matrix, persisted beside it. With them |v - c|^2 = |v|^2 - 2 v.c + |c|^2, and when a
centroid moves, only its components that changed count: v.c grows by v times the change. A
round is one pass without a shuffle: read (vector, dots), add the changes, take the argmin,
write. Sums of each cluster are added within a task first; the centroids themselves (``k``
rows, whatever the input) are the only thing the driver holds, in Python's integers.

All numbers are integers of 64 bits. A component beyond ``bound(dims)`` (2^27 for 64
components), with which a squared distance could leave them, ends the job with an error.

Defined cases: vectors that are null, of another length, or hold a null or non-finite
component are left out; a null id takes no part in the choice of the first centroids but is
clustered; equal hashes (repeated ids) order by components, nulls by none; repeated rows count
one by one; with fewer vectors than ``k`` there are as many centroids; extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.llm.store import dropped, written


@dataclass
class Clustering:
    """``rows``: id, cluster, distance (and ``v``, ``dots``); the centroids they stand to;
    the squared distances summed for each cluster."""

    rows: DataFrame
    centroids: list[list[int]]
    inertia: dict[int, int]


def bound(dims: int) -> int:
    """Largest component for which dims squared differences fit in 63 bits."""
    return math.isqrt((1 << 61) // dims)


def integers(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v): the kept vectors with components floor(scale * x)."""
    vec = F.col(vec_col)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    kept = df.select(F.col(id_col).alias("id"), vec.alias("v")).where((F.size(vec) == dims) & finite)
    fits = F.forall("v", lambda x: F.abs(x.cast("double") * scale) <= bound(dims))
    too_large = F.raise_error(F.lit(f"a component is beyond {bound(dims)} / {scale}: distances would not fit in a long"))
    return kept.select("id", F.when(fits, F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("int"))).otherwise(too_large.cast("array<int>")).alias("v"))


def _matrix(column, width: int):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _step(state: DataFrame, old: list[list[int]], new: list[list[int]]) -> DataFrame:
    """One round: dots are brought from the old centroids to the new ones by the components
    that changed, then each vector takes the nearest."""
    import numpy as np
    import pyarrow as pa

    k, dims = len(new), len(new[0])
    change = np.array(new, np.int64) - np.array(old, np.int64)
    moved = [(at, change[j, at]) for j in range(k) for at in [np.flatnonzero(change[j])]]
    square = np.array([sum(x * x for x in c) for c in new], np.int64)
    kind = state.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v, dots = _matrix(b.column(1), dims), _matrix(b.column(2), k).copy()
            for j, (at, by) in enumerate(moved):
                if len(at):
                    dots[:, j] += v[:, at] @ by
            far = (v * v).sum(axis=1)[:, None] - 2 * dots + square
            cluster = far.argmin(axis=1)  # the smaller number of equal ones
            offsets = pa.array(np.arange(0, dots.size + 1, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(dots.ravel())), pa.array(cluster.astype(np.int32)), pa.array(far[np.arange(len(v)), cluster])],
                ["id", "v", "dots", "cluster", "distance"])

    return state.select("id", "v", "dots").mapInArrow(run, f"id {kind}, v array<int>, dots array<bigint>, cluster int, distance bigint")


def _sums(state: DataFrame, k: int, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Per cluster its size and componentwise sum, added in the tasks first."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            cluster, v = b.column(0).to_numpy(), _matrix(b.column(1), dims)
            for j in np.unique(cluster):
                total[j] += v[cluster == j].sum(axis=0)
            count += np.bincount(cluster, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(count), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = state.select("cluster", "v").mapInArrow(run, "cluster int, n bigint, total array<bigint>").where("n > 0")
    places = parts.select("cluster", "n", F.posexplode("total"))
    exact = places.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in exact.collect():  # k x dims rows
        out.setdefault(r["cluster"], (r["n"], [0] * dims))[1][r["pos"]] = int(r["s"])
    return out


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vec_col: str = "embedding") -> Clustering:
    """Centroids start as the ``k`` vectors whose sha256 of ``seed:id`` is smallest; each of
    ``rounds`` rounds assigns all vectors, then moves every non-empty centroid to the floor
    of its vectors' mean; a last pass assigns them again."""
    vectors = written(integers(df, id_col, vec_col, dims, scale), "vectors")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.where("id is not null").orderBy(draw, "v").limit(k).select("v").collect()
    new = [list(r["v"]) for r in first]
    if not new:
        none = vectors.select("id", "v", F.array().cast("array<bigint>").alias("dots"), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("bigint").alias("distance"))
        return Clustering(none.limit(0), [], {})
    k = len(new)
    old = [[0] * dims for _ in new]
    state = vectors.withColumn("dots", F.array_repeat(F.lit(0).cast("bigint"), k))
    before = vectors
    for r in range(rounds + 1):
        state = written(_step(state, old, new), f"distances-{r}")
        dropped(before)
        before = state
        if r < rounds:
            old, sums = new, _sums(state, k, dims)
            new = [[s // sums[j][0] for s in sums[j][1]] if j in sums else c for j, c in enumerate(old)]
    far = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    return Clustering(state, new, {r["cluster"]: int(r["s"]) for r in far})


def with_totals(found: Clustering) -> DataFrame:
    """Rows with their cluster's and the whole inertia and a digest of their centroid."""
    rows = found.rows
    if not found.centroids:
        return rows.select("id", "cluster", "distance", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))])
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster"))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    each = [found.inertia.get(j, 0) for j in range(len(found.centroids))]
    return rows.select("id", "cluster", "distance", of(each).cast("bigint").alias("cluster_inertia"), F.lit(sum(each)).cast("bigint").alias("inertia"), of(digest).alias("centroid_sha256"))
