"""Embedding near-dedup (operator 7): a small-world graph per shard.

Vectors of one label and length are dealt into shards of about ``shard_rows``; each shard
becomes a hierarchical navigable small-world graph. All vectors of the label, in blocks,
query every one of its shards: a descent through the layers, a beam over the lowest one,
then a walk along links whose ends are within reach. A sample of each block is held against
brute force over the shard, a query's match with itself left out. Queries are sampled by the
number of links found, so that those beside dense groups do not stand for all, and the sample
of those without any is widened until it holds a true link or ``AUDIT_CLEAR`` of them had none
(by then at most 1 in 100 can have one, at 95 %). The recall is taken per query and separately
for queries with few and with many true links; while one of them is below ``recall``, beam and
reach are widened and the block is asked again. Where a beam of an eighth of the shard is not
enough, the block is compared with the whole shard, so it ends. Links are verified by cosine
in double precision and united into components.

A block and shard pair returns one count per query and a spanning forest of its links,
never the links themselves. Equal vectors are one vector with a weight.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components,
and rows without a label, link with nothing and are their own component; vectors of
different lengths do not link; repeated rows are linked copies; a null id counts as no id
(component_id is the smallest id that is not null, null if there is none); an empty table
gives an empty table.
"""

from __future__ import annotations

import math
import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.llm.components import Forest, components
from tablekit.llm.store import written

LINKS = 24
BASE_LINKS = 48
BUILD_BEAM = 64
#: Links across an upper layer, and starts that a search takes from one layer to the next.
FAR = 6
STARTS = 6
BATCH = 512
#: Queries without links that are audited before a block counts as one without rare links.
AUDIT_CLEAR = 300
AUDIT_ROWS = 48
#: True links up to which a query counts as one with few.
FEW = 8
SLACK = 1e-5


class Graph:
    """Layers of links over unit vectors (float32): layer 0 holds all of them, each higher
    one about 1/16 of the one below."""

    def __init__(self, unit, seed: int = 7):
        import numpy as np

        self.x = unit
        n = len(unit)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(16)).astype(int)
        order = np.argsort(-level, kind="stable")
        self.layers: list[tuple] = []  # top first: (nodes, links by node position)
        top = int(level.max()) if n else 0
        for at in range(top, 0, -1):
            nodes = order[: int((level >= at).sum())]
            self.layers.append(self._small(nodes))
        self._base(order, max(1, int((level >= 1).sum())))

    def _small(self, nodes):
        """An upper layer: each node's nearest, exactly, and some links across the layer, so
        that a dense group does not end the way; a block of nodes at a time."""
        import numpy as np

        k = min(LINKS - FAR, len(nodes) - 1)
        links = np.full((len(self.x), LINKS), -1, np.int32)
        if len(nodes) > LINKS:
            links[nodes, LINKS - FAR :] = nodes[np.random.default_rng(len(nodes)).integers(0, len(nodes), (len(nodes), FAR))]
        for i in range(0, len(nodes), BATCH):
            sim = self.x[nodes[i : i + BATCH]] @ self.x[nodes].T
            sim[np.arange(len(sim)), np.arange(i, i + len(sim))] = -2
            if k > 0:
                links[nodes[i : i + BATCH], :k] = nodes[np.argpartition(-sim, k - 1, axis=1)[:, :k]]
        mine = np.sort(links[nodes], axis=1)  # no node twice
        mine[:, 1:][mine[:, 1:] == mine[:, :-1]] = -1
        links[nodes] = mine
        return nodes, links

    def _base(self, order, first: int) -> None:
        """The lowest layer: the upper layers' nodes first, then all others in batches that
        search the graph so far and each other for their neighbours."""
        import numpy as np

        n = len(order)
        self.links = np.full((n, BASE_LINKS), -1, np.int32)
        if n == 0:
            return
        nodes, links = self._small(order[:first])
        self.links[:, :LINKS] = links
        self.start = order[0]
        done = first
        while done < n:
            new = order[done : done + min(BATCH, max(done, 32))]
            ids, sim = self.beam(self.x[new], BUILD_BEAM)
            own = self.x[new] @ self.x[new].T
            np.fill_diagonal(own, -2)
            k = min(16, len(new) - 1)
            if k > 0:
                near = np.argpartition(-own, k - 1, axis=1)[:, :k]
                ids = np.concatenate([ids, new[near]], axis=1)
                sim = np.concatenate([sim, np.take_along_axis(own, near, axis=1)], axis=1)
            best = np.argsort(-sim, axis=1, kind="stable")
            ids, sim = np.take_along_axis(ids, best, axis=1), np.take_along_axis(sim, best, axis=1)
            chosen = self._diverse(ids, sim)
            for row, at in enumerate(new):
                got = ids[row][chosen[row]][:LINKS]
                self.links[at, : len(got)] = got
            self._back(new)
            done += len(new)

    def _diverse(self, ids, sim):
        """Which candidates (nearest first) to link: those nearer to the node than to any
        candidate chosen before, filled up with the nearest others."""
        import numpy as np

        v = self.x[np.maximum(ids, 0)]
        between = np.einsum("bid,bjd->bij", v, v)
        ok = ids >= 0
        chosen = np.zeros(ids.shape, bool)
        worst = np.full(ids.shape, -2.0, np.float32)  # nearness to the chosen
        for j in range(ids.shape[1]):
            take = ok[:, j] & (sim[:, j] > worst[:, j]) & (chosen.sum(axis=1) < LINKS)
            chosen[:, j] = take
            worst = np.where(take[:, None], np.maximum(worst, between[:, j]), worst)
        room = LINKS - chosen.sum(axis=1, keepdims=True)
        rest = ok & ~chosen
        return chosen | rest & (np.cumsum(rest, axis=1) <= room)

    def _back(self, new) -> None:
        """Links back from the new nodes' neighbours; a full list keeps the nearest."""
        import numpy as np

        a = np.repeat(new, BASE_LINKS)
        b = self.links[new].ravel()
        a, b = a[b >= 0], b[b >= 0]
        touched = np.unique(b)
        old = self.links[touched]
        src = np.concatenate([np.repeat(touched, BASE_LINKS), b])
        dst = np.concatenate([old.ravel(), a])
        src, dst = src[dst >= 0], dst[dst >= 0]
        pair = np.unique(src.astype(np.int64) * len(self.x) + dst)
        src, dst = pair // len(self.x), pair % len(self.x)
        sim = np.einsum("id,id->i", self.x[src], self.x[dst])
        by = np.lexsort((-sim, src))
        src, dst = src[by], dst[by]
        rank = np.arange(len(src)) - np.searchsorted(src, src)
        keep = rank < BASE_LINKS
        self.links[touched] = -1
        self.links[src[keep], rank[keep]] = dst[keep]

    def _walk(self, q, ids, links, width: int):
        """Best-first search of all queries side by side: ids are the starts (one column)."""
        import numpy as np

        n, rows = len(q), np.arange(len(q))
        seen = np.zeros((n, len(self.x)), bool)
        seen[rows[:, None], ids] = True
        sim = np.einsum("qd,qkd->qk", q, self.x[ids])
        done = np.zeros(ids.shape, bool)
        while True:
            open_ = np.where(done | (ids < 0), -3.0, sim)
            at = open_.argmax(axis=1)
            live = open_[rows, at] > -3.0
            if not live.any():
                return ids, sim
            done[rows, at] = True
            r = rows[live]
            near = links[ids[r, at[r]]]
            fresh = (near >= 0) & ~seen[r[:, None], np.maximum(near, 0)]
            seen[r[:, None], np.where(fresh, near, ids[r, at[r]][:, None])] = True
            value = np.where(fresh, np.einsum("qd,qkd->qk", q[r], self.x[np.maximum(near, 0)]), -3.0)
            all_near = np.full((n, near.shape[1]), -1, ids.dtype)
            all_value = np.full((n, near.shape[1]), -3.0, np.float32)
            all_near[r], all_value[r] = np.where(fresh, near, -1), value
            ids = np.concatenate([ids, all_near], axis=1)
            sim = np.concatenate([sim, all_value], axis=1)
            done = np.concatenate([done, np.zeros(all_near.shape, bool)], axis=1)
            if ids.shape[1] > width:
                keep = np.argpartition(-sim, width - 1, axis=1)[:, :width]
                ids, sim, done = (np.take_along_axis(z, keep, axis=1) for z in (ids, sim, done))

    def beam(self, q, width: int):
        """ids (-1 for none) and similarities of about the ``width`` nearest of each query."""
        import numpy as np

        ids = np.full((len(q), 1), self.layers[0][0][0] if self.layers else self.start, np.int64)
        for _, links in self.layers:
            ids, sim = self._walk(q, ids, links, 16)
            best = np.argsort(-sim, axis=1, kind="stable")[:, :STARTS]
            ids = np.take_along_axis(ids, best, axis=1)
            while ids.shape[1] > 1 and (ids < 0).any():
                ids = ids[:, :-1]
        return self._walk(q, ids, self.links, max(width, 1))

    def within(self, q, least: float, width: int, reach: float):
        """(query, node) pairs of similarity ``least`` and more: the beam's, and those that a
        walk over links between nodes of similarity ``least - reach`` and more comes to."""
        import numpy as np

        ids, sim = self.beam(q, width)
        seen = np.zeros((len(q), len(self.x)), bool)
        row, col = np.nonzero((ids >= 0) & (sim >= least - reach))
        node, value = ids[row, col], sim[row, col]
        out_q, out_n = [row[value >= least]], [node[value >= least]]
        seen[row, node] = True
        while len(row):
            near = self.links[node]
            r = np.repeat(row, near.shape[1])
            near = near.ravel()
            r, near = r[near >= 0], near[near >= 0]
            new = ~seen[r, near]
            key = np.unique(r[new].astype(np.int64) * len(self.x) + near[new])
            r, near = key // len(self.x), key % len(self.x)
            seen[r, near] = True
            value = np.empty(len(r), np.float32)
            for i in range(0, len(r), 1 << 16):
                value[i : i + (1 << 16)] = np.einsum("id,id->i", q[r[i : i + (1 << 16)]], self.x[near[i : i + (1 << 16)]])
            out_q.append(r[value >= least])
            out_n.append(near[value >= least])
            row, node = r[value >= least - reach], near[value >= least - reach]
        return np.concatenate(out_q), np.concatenate(out_n)


def search(graph: Graph, q, least: float, recall: float, own=None, width: int = 32, reach: float = 0.02):
    """The links of a block of queries, asked again with a wider beam until the audit passes.
    ``own`` is each query's own node, -1 where it is not in the graph."""
    import numpy as np

    own = np.full(len(q), -1) if own is None else own
    audit = Audit(graph, q, least, own)
    while True:
        a, b = [], []
        for i in range(0, len(q), BATCH):
            x, y = graph.within(q[i : i + BATCH], least, width, reach)
            a.append(x + i)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        if audit.passes(a, b, recall):
            return a, b
        width, reach = 4 * width, 2 * reach
        if 8 * width > len(graph.x):
            return audit.whole()


class Audit:
    """Holds samples of a block's links against brute force."""

    def __init__(self, graph: Graph, q, least: float, own):
        import numpy as np

        self.graph, self.q, self.least, self.own = graph, q, least, own
        self.order = np.random.default_rng(11).permutation(len(q))
        self.truth: dict[int, set[int]] = {}

    def _true(self, rows):
        """The true links of each of the rows, itself left out; kept for later rounds."""
        import numpy as np

        new = np.array([r for r in rows if r not in self.truth], int)
        for i in range(0, len(new), BATCH):
            part = new[i : i + BATCH]
            r, c = np.nonzero(self.q[part] @ self.graph.x.T >= self.least)
            for x in part:
                self.truth[int(x)] = set()
            for x, y in zip(part[r].tolist(), c.tolist()):
                if y != self.own[x]:
                    self.truth[x].add(y)
        return [self.truth[int(r)] for r in rows]

    def passes(self, a, b, recall: float) -> bool:
        import numpy as np

        other = b != self.own[a]
        a, b = a[other], b[other]
        found = np.bincount(a, minlength=len(self.q))
        hits: dict[bool, list] = {True: [0.0, 0.0], False: [0.0, 0.0]}  # few links? recall, queries
        for low, high in ((0, 0), (1, FEW), (FEW + 1, len(self.graph.x))):
            mine = self.order[(found[self.order] >= low) & (found[self.order] <= high)]
            n = min(AUDIT_ROWS, len(mine))
            while high == 0 and n < min(AUDIT_CLEAR, len(mine)) and not any(self._true(mine[:n])):
                n = min(2 * n, AUDIT_CLEAR, len(mine))
            pick = np.isin(a, mine[:n])
            got: dict[int, set[int]] = {}
            for x, y in zip(a[pick].tolist(), b[pick].tolist()):
                got.setdefault(x, set()).add(y)
            for x, true in zip(mine[:n].tolist(), self._true(mine[:n])):
                if true:
                    at = hits[len(true) <= FEW]
                    at[0] += len(true & got.get(x, set())) / len(true) * len(mine) / n
                    at[1] += len(mine) / n
        return all(got >= recall * n for got, n in hits.values())

    def whole(self):
        """All links of the block, by comparison with the whole shard."""
        import numpy as np

        a, b = [], []
        for i in range(0, len(self.q), BATCH):
            r, c = np.nonzero(self.q[i : i + BATCH] @ self.graph.x.T >= self.least)
            a.append(r + i)
            b.append(c)
        return np.concatenate(a), np.concatenate(b)


def _table(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    ok = F.coalesce((F.size(v) > 0) & whole & F.col(label_col).isNotNull(), F.lit(False))
    return df.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), ok.alias("ok"))


def near_dups(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98, recall: float = 0.98, shard_rows: int = 8192, block_rows: int = 2048) -> DataFrame:
    """id_col, n_links, component_id and kept for every row."""
    import numpy as np
    import pandas as pd

    kind = df.schema[id_col].dataType.simpleString()
    rows = written(_table(df, id_col, vec_col, label_col).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    # equal vectors meet in the map tasks: a vector that a third of the rows share is one row a task
    reps = written(rows.where("ok").groupBy("label", "v").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("weight")), "vector-reps")
    sizes = reps.groupBy("label", F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    sizes = written(sizes.select("label", "dim", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"), F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")), "vector-sizes")
    mixed = lambda seed: F.xxhash64(F.lit(seed), F.col("rep"))
    placed = reps.withColumn("dim", F.size("v")).join(sizes, ["label", "dim"])
    placed = placed.withColumn("shard", F.pmod(mixed(1), F.col("shards")).cast("int")).withColumn("block", F.pmod(mixed(2), F.col("blocks")).cast("int"))
    placed = written(placed, "vector-places")

    def build(key, pdf):
        pdf = pdf.sort_values("rep")
        x = np.stack(pdf["v"].to_numpy())
        # by the largest component first: squares of very large or small ones stay in range
        x = x / np.abs(x).max(axis=1, keepdims=True)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        graph = Graph(unit.astype(np.float32))
        data = pickle.dumps((graph, unit, pdf["rep"].to_numpy(), pdf["weight"].to_numpy()))
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "blocks": [int(pdf["blocks"].iloc[0])], "graph": [data]})

    graphs = placed.select("label", "dim", "shard", "blocks", "rep", "weight", "v").groupBy("label", "dim", "shard").applyInPandas(build, "label string, dim int, shard int, blocks int, graph binary")
    graphs = written(graphs, "vector-graphs", "none")
    asked = graphs.select("label", "dim", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "graph")
    queries = placed.select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block", "rep", "v")

    def ask(key, g, pdf):
        empty = pd.DataFrame({"rep": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64"), "root": pd.Series([], dtype="int64")})
        if not len(g) or not len(pdf):
            return empty
        graph, unit, rep, weight = pickle.loads(g["graph"].iloc[0])
        pdf = pdf.sort_values("rep")
        x = np.stack(pdf["v"].to_numpy())
        x = x / np.abs(x).max(axis=1, keepdims=True)
        q, who = x / np.linalg.norm(x, axis=1, keepdims=True), pdf["rep"].to_numpy()
        place = {r: i for i, r in enumerate(rep.tolist())}
        own = np.array([place.get(w, -1) for w in who.tolist()])
        a, b = search(graph, q.astype(np.float32), least - SLACK, recall, own)
        exact = np.empty(len(a))
        for i in range(0, len(a), 1 << 16):
            exact[i : i + (1 << 16)] = np.einsum("id,id->i", q[a[i : i + (1 << 16)]], unit[b[i : i + (1 << 16)]])
        good = (exact >= least) & (who[a] != rep[b])
        a, b = a[good], b[good]
        counts = np.bincount(a, weights=weight[b].astype(float), minlength=len(who)).astype(np.int64)
        f = Forest()
        for x_, y_ in zip(who[a].tolist(), rep[b].tolist()):
            f.join(x_, y_)
        # each node's link to its root; the counts ride along on the queries' own rows
        out = f.links()
        return pd.DataFrame({"rep": np.concatenate([who, np.array([x for x, _ in out], np.int64)]), "n": np.concatenate([counts, np.zeros(len(out), np.int64)]), "root": np.concatenate([who, np.array([r for _, r in out], np.int64)])})

    key = ["label", "dim", "shard", "block"]
    found = written(asked.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(ask, "rep bigint, n bigint, root bigint"), "vector-links")
    degree = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comps = components(found.where("rep <> root"), "rep", "root")
    marked = reps.select("label", "v", "rep", "weight").join(degree, "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    marked = written(marked.select("label", "v", (F.col("n") + F.col("weight") - 1).alias("n"), F.coalesce("comp", "rep").alias("comp")), "vector-comps")
    linked = rows.join(marked.withColumnRenamed("label", "l").withColumnRenamed("v", "w"), F.col("ok") & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left").select("id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("comp", "rid").alias("comp"), F.col("n").isNotNull().alias("in"))
    linked = written(linked, "vector-rows")
    first = written(linked.where("in").groupBy("comp").agg(F.min("id").alias("first")), "vector-first")
    out = linked.join(first.withColumnRenamed("comp", "c"), F.col("in") & (F.col("comp") == F.col("c")), "left")
    component = F.when(F.col("in"), F.col("first")).otherwise(F.col("id")).cast(kind)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
