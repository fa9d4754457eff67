"""Connected components of a link table by contraction, all in Spark tables.

Links are dealt into partitions of at most ``LINKS_AT_ONCE`` and reduced to a spanning
forest within each. While that takes more than one partition, every node picks the neighbour
(or itself) of the lowest hash, a new hash each round, and the links are renamed to the
picks; tables shrink by a constant factor a round in expectation, also on long chains. The
forest of the last partition names the components. The picks are written first, so that the joins read two plain
exchanges and adaptive execution can split those of a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.llm.store import dropped, written


#: Links that one task reduces to a forest.
LINKS_AT_ONCE = 400_000


class Forest:
    """Union-find over any hashable nodes; the root is the smallest node."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if y < x:
            x, y = y, x
        self.up[y] = x
        return True

    def links(self):
        """(node, root) of all nodes that are not roots."""
        return [(x, r) for x in self.up if (r := self.find(x)) != x]


def _forest(links: DataFrame) -> DataFrame:
    """A spanning forest of each partition's links: no more links than nodes."""
    import pyarrow as pa

    def run(batches):
        f = Forest()
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f.join(x, y)
        out = f.links()
        for i in range(0, len(out), 1 << 16):
            part = out[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([y for _, y in part], pa.int64())], ["a", "b"])

    return links.mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, a: str = "a", b: str = "b", at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """(node, comp) of every node in ``links`` (bigint columns); comp is one of its nodes."""
    spark = links.sparkSession
    now = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"), "links")
    label, round_ = None, 0
    while True:
        parts = max(1, -(-now.count() // at_once))
        trees = written(_forest(now.repartition(parts)), "forest")
        dropped(now)
        if parts == 1:
            # all links met: each node's root is its component
            roots = trees.select(F.col("a").alias("node"), F.col("b").alias("up"))
            roots = written(roots.union(trees.select("b", "b").distinct()), "roots")
            return roots.withColumnRenamed("up", "comp") if label is None else written(_renamed(label, roots), "labels")
        rank = lambda c: F.xxhash64(F.col(c), F.lit(round_))
        both = trees.select("a", "b").union(trees.select("b", "a"))
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("h"), F.col("b").alias("b"))).alias("m"))
        pick = written(best.select(F.col("a").alias("node"), F.when(F.col("m.h") < rank("a"), F.col("m.b")).otherwise(F.col("a")).alias("up")), "picks")
        label = pick.withColumnRenamed("up", "comp") if label is None else written(_renamed(label, pick), "labels")
        step = trees.join(pick, F.col("a") == F.col("node")).select(F.col("up").alias("a"), "b")
        step = step.join(pick, F.col("b") == F.col("node")).select("a", F.col("up").alias("b")).where("a <> b")
        now = written(step.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        dropped(trees)
        round_ += 1


def _renamed(label: DataFrame, names: DataFrame) -> DataFrame:
    """Labels (node, comp) under the new names (node, up) of their components."""
    old = label.withColumnRenamed("node", "n")
    return old.join(names, F.col("comp") == F.col("node"), "left").select(F.col("n").alias("node"), F.coalesce("up", "comp").alias("comp"))
