"""Exact quantiles. Of whole columns: ``column_quantiles``, a sketch that brackets each
position, then counts. Of groups: ``value_quantiles``, by value counts and running sums.

For groups, values are counted first, so partial aggregation collapses a hot value inside each map
task; the counts (one row per distinct value) are range-partitioned and written once. The
totals per partition say which partition holds a needed position, and only those
partitions' rows get running sums. No task holds a whole column or group.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablekit.functions.joins import materialize


def value_counts_ranged(values: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """keys, ``value``, ``c`` (rows) and ``pid``: counts ordered over partitions by (keys, value)."""
    n = partitions or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = values.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c"))
    return materialize(counts.repartitionByRange(n, *keys, "value").withColumn("pid", F.spark_partition_id()))


def value_quantiles(values: DataFrame, keys: list[str], ps: list[float]) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per ``keys``: keys and ``q``, an array in
    the order of ``ps``. Keys without a value have no row."""
    ranged = value_counts_ranged(values, keys)
    totals = ranged.groupBy(*keys, "pid").agg(F.sum("c").alias("t"))
    # one row per key and partition that holds it
    before = Window.partitionBy(*keys).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "pid", "t", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("off"), F.sum("t").over(Window.partitionBy(*keys)).alias("n"))
    h = [F.lit(float(p)) * (F.col("n") - 1) for p in ps]
    needs = F.array(*[F.struct(F.lit(i).alias("i"), (x - F.floor(x)).alias("frac"), F.floor(x).cast("bigint").alias("lo"), F.ceil(x).cast("bigint").alias("hi")) for i, x in enumerate(h)])
    wanted = totals.select("*", F.explode(needs).alias("s")).select(*keys, "pid", "off", "t", "s.i", "s.frac", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("s.lo").alias("pos")), F.struct(F.lit(1).alias("side"), F.col("s.hi").alias("pos")))).alias("w"))
    wanted = wanted.where((F.col("w.pos") >= F.col("off")) & (F.col("w.pos") < F.col("off") + F.col("t"))).select(*keys, "pid", "i", "frac", "w.side", (F.col("w.pos") - F.col("off")).alias("pos"))
    held = ranged.join(wanted.select(*keys, "pid").distinct(), [*keys, "pid"], "left_semi")
    up = Window.partitionBy(*keys, "pid").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = held.withColumn("end", F.sum("c").over(up))
    found = running.join(wanted, [*keys, "pid"]).where((F.col("pos") >= F.col("end") - F.col("c")) & (F.col("pos") < F.col("end")))
    ends = found.groupBy(*keys, "i").agg(F.first("frac").alias("frac"), F.max(F.when(F.col("side") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("b"))
    q = F.col("a") + F.col("frac") * (F.col("b") - F.col("a"))
    return ends.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", q.alias("q")))), lambda x: x["q"]).alias("q"))


# -- whole columns: a sketch brackets each position --------------------------------------

#: Relative rank error of the sketch is one over this.
SKETCH = 10_000
#: Rows in a bracket that the driver takes (as value counts).
AT_MOST = 1 << 16
#: Columns of one aggregate.
WIDE = 64


def column_quantiles(src: DataFrame, cols: list[str], ps: list[float], at_most: int = AT_MOST, accuracy: int = SKETCH, also: list = (), seen: list | None = None) -> dict[str, list[float] | None]:
    """Exact linear-interpolated quantiles of numeric columns (null: missing), None for a
    column without a value. No value is shuffled but those next to a needed position.

    Pass 1 builds a mergeable sketch of every column, which brackets each position between
    two values. Pass 2 counts the rows below and inside each bracket, so the bracket is known
    to hold the position (else it is opened on that side); one with more than ``at_most``
    rows and more than one value is sketched again from the rows inside it. Pass 3 counts the
    values inside the brackets, at most ``at_most`` rows each, and picks the positions.
    A bracket that no longer shrinks, as hot values fill it, is taken by its value counts.

    ``also``: further aggregates over ``src`` for pass 1; their row goes to ``seen``.
    """
    out: dict[str, list[float] | None] = {}
    for i in range(0, len(cols), WIDE):
        out.update(_column_quantiles(src, cols[i : i + WIDE], ps, at_most, accuracy, also if i == 0 else (), seen))
    return out


def _column_quantiles(src, cols, ps, at_most, accuracy, also, seen):
    import math

    eps = 2 / accuracy
    whole = src
    src = src.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)])

    def sketch(x, shares):
        at = [min(1.0, max(0.0, p + side)) for p in shares for side in (-eps, eps)]
        return F.percentile_approx(x, F.array(*map(F.lit, at)), F.lit(accuracy))

    # one sketch for each column gives the brackets of all its positions
    named = whole.select("*", *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)]) if also else src
    first = named.agg(*also, *[F.count(f"x{i}").alias(f"n{i}") for i in range(len(cols))], *[sketch(F.col(f"x{i}"), ps).alias(f"s{i}") for i in range(len(cols))]).first()
    n = [first[f"n{i}"] for i in range(len(cols))]
    need = {(i, j): (math.floor(p * (n[i] - 1)), math.ceil(p * (n[i] - 1))) for i in range(len(cols)) if n[i] for j, p in enumerate(ps)}
    open_ = {(i, j): tuple(first[f"s{i}"][2 * j : 2 * j + 2]) for i, j in need}
    inside: dict = {}
    if also and seen is not None:
        seen.append(first)
    while open_:
        counts = src.agg(*[e for (i, j), (lo, hi) in open_.items() for e in (
            F.count_if(F.col(f"x{i}") < lo).alias(f"b{i}_{j}"), F.count_if(F.col(f"x{i}").between(lo, hi)).alias(f"i{i}_{j}"))]).first()
        again = {}
        for key, (lo, hi) in open_.items():
            below, held = counts["b{}_{}".format(*key)], counts["i{}_{}".format(*key)]
            a, b = need[key]
            if a < below or b >= below + held:
                again[key] = None, (-math.inf if a < below else lo), (math.inf if b >= below + held else hi)
                continue
            stuck = key in inside and held >= inside[key][3]
            inside[key] = lo, hi, below, held
            if held > at_most and lo < hi and not stuck:
                again[key] = ((a - below) / held, (b - below) / held), lo, hi
        open_ = {key: (lo, hi) for key, (share, lo, hi) in again.items() if share is None}
        closer = {key: x for key, x in again.items() if x[0] is not None}
        if closer:
            got = src.agg(*[sketch(F.when(F.col(f"x{i}").between(lo, hi), F.col(f"x{i}")), share).alias(f"s{i}_{j}") for (i, j), (share, lo, hi) in closer.items()]).first()
            open_.update({key: (got["s{}_{}".format(*key)][0], got["s{}_{}".format(*key)][3]) for key in closer})
    values: dict = {key: [(lo, held)] for key, (lo, hi, _, held) in inside.items() if lo == hi}
    rest = [key for key in inside if key not in values]
    if rest:
        each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.when(F.col(f"x{i}").between(inside[i, j][0], inside[i, j][1]), F.col(f"x{i}")).alias("v")) for i, j in rest])
        some = reduce(or_, [F.col(f"x{i}").between(inside[i, j][0], inside[i, j][1]) for i, j in rest])
        near = src.where(some).select(F.explode(each).alias("e")).where(F.col("e.v").isNotNull()).groupBy("e.i", "e.j", "e.v").agg(F.count(F.lit(1)).alias("c"))
        hot = [key for key in rest if inside[key][3] > at_most]
        if hot:  # hot values: their distinct number decides
            near = materialize(near)
            many = {(r["i"], r["j"]) for r in near.groupBy("i", "j").count().where(F.col("count") > at_most).collect()}
            for key in many:
                values[key] = None
            near = near.where(~F.struct("i", "j").isin([F.struct(F.lit(i), F.lit(j)) for i, j in many])) if many else near
        for r in near.collect():
            values.setdefault((r["i"], r["j"]), []).append((r["v"], r["c"]))
    out = {}
    for i, c in enumerate(cols):
        if not n[i]:
            out[c] = None
            continue
        if any(values[i, j] is None for j in range(len(ps))):
            long = src.select(F.lit(c).alias("k"), F.col(f"x{i}").alias("value"))
            out[c] = list(value_quantiles(long, ["k"], ps).first()["q"])
            continue
        q = []
        for j, p in enumerate(ps):
            found, at = [], inside[i, j][2]
            for v, k in sorted(values[i, j]):
                found += [v for pos in sorted(set(need[i, j])) if at <= pos < at + k]
                at += k
            h = p * (n[i] - 1)
            q.append(found[0] if found[0] == found[-1] else found[0] + (h - math.floor(h)) * (found[-1] - found[0]))
        out[c] = q
    return out
