"""Profiling operators (aggregations).

Plan shape: every profile is ONE scan with ONE aggregate over all requested
columns, then an explode of an array of structs to the long form (one row per
column). Distinct counts go through an unpivot → groupBy(column, value) →
groupBy(column) so map-side partial aggregation collapses hot values before the
shuffle, instead of N ``count(distinct)`` that would expand every row N times.

Exact quantiles come from distributed value counts and running sums at every
size (``functions/quantiles.py``); ``approx=True`` gives ``percentile_approx``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekit.functions.comoments import co_moments, pair_correlation
from tablekit.functions.joins import bounded_broadcast, materialize
from tablekit.functions.quantiles import column_quantiles
from tablekit.functions.stats import (clean, is_missing, numeric_columns,
                                      other_columns, r2, r4, safe_corr,
                                      sample_kurtosis, sample_skew)


def exact_quantiles(df: DataFrame, cols: list[str], ps: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles: ``(column_name, q)`` with ``q`` an array in the
    order of ``ps``, by sketches and counts (``functions/quantiles.py``); a row per column
    that has a value. Its jobs run here."""
    src = df.select(*[clean(df, c).cast("double").alias(c) for c in cols])
    q = column_quantiles(src, cols, ps)
    rows = [(c, [float(x) for x in v]) for c, v in q.items() if v is not None]
    return df.sparkSession.createDataFrame(rows, "column_name string, q array<double>")


def median_row(df: DataFrame, cols: list[str], prefix: str = "", *, approx: bool = False) -> DataFrame:
    """One row of medians named ``prefix + column``, exact unless ``approx``."""
    if approx:
        return df.agg(*[F.percentile_approx(clean(df, c).cast("double"), 0.5, 10000).cast("double")
                        .alias(prefix + c) for c in cols])
    q = exact_quantiles(df, cols, [0.5])
    return q.agg(*[F.first(F.when(F.col("column_name") == c, F.col("q")[0]), ignorenulls=True)
                   .alias(prefix + c) for c in cols])


def _approx_quantiles(x: Column, ps: list[float], accuracy: int) -> Column:
    return F.percentile_approx(x, F.array(*[F.lit(p) for p in ps]), accuracy)


def _explode_structs(wide: DataFrame, structs: list[Column]) -> DataFrame:
    if not structs:
        raise ValueError("no columns to profile")
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def numeric_profile(df: DataFrame, columns: list[str] | None = None, *,
                    approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """A1: mean, std (n-1), min, quartiles, max, skew, kurtosis per numeric column."""
    cols = columns or numeric_columns(df)
    src = df.select(*[clean(df, c).cast("double").alias(c) for c in cols])
    out_cols = ["column_name", "mean", "std", "min", "p25", "p50", "p75", "max", "skew", "kurtosis"]
    structs = []
    for c in cols:
        x = F.col(c)
        q = [_approx_quantiles(x, [0.25, 0.5, 0.75], accuracy)[i] if approx else F.lit(None).cast("double")
             for i in range(3)]
        structs.append(F.struct(
            F.lit(c).alias("column_name"),
            r4(F.avg(x)).alias("mean"), r4(F.stddev_samp(x)).alias("std"),
            r4(F.min(x)).alias("min"), r4(q[0]).alias("p25"), r4(q[1]).alias("p50"),
            r4(q[2]).alias("p75"), r4(F.max(x)).alias("max"),
            r4(sample_skew(x)).alias("skew"), r4(sample_kurtosis(x)).alias("kurtosis")))
    # aggregates sit inside the array of structs: still a single Aggregate node
    if approx:
        return src.agg(F.array(*structs).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    # the quantiles' first pass takes the other aggregates along
    seen: list = []
    found = column_quantiles(src, cols, [0.25, 0.5, 0.75], also=[F.array(*structs).alias("__profile")], seen=seen)
    kinds = "column_name string, " + ", ".join(f"{n} double" for n in out_cols[1:])
    rows = [tuple({**s.asDict(), **dict(zip(("p25", "p50", "p75"), found[s["column_name"]] or (None,) * 3))}[n] for n in out_cols) for s in seen[0]["__profile"]]
    return df.sparkSession.createDataFrame(rows, kinds).select("column_name", *[r4(F.col(n)).alias(n) if n in ("p25", "p50", "p75") else n for n in out_cols[1:]])


def _unpivot_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value) rows with value as string, NULL/NaN dropped."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"),
                               F.when(~is_missing(df, c), F.col(c).cast("string"))
                               .alias("value")) for c in cols])
    return (df.select(F.explode(pairs).alias("p")).select("p.*")
              .where(F.col("value").isNotNull()))


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, cnt): partial-aggregated before the shuffle."""
    return _unpivot_values(df, cols).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("cnt"))


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """n_distinct per column that has a value. Values are compared by two 64-bit hashes, so
    16 bytes of a value are shuffled, once per map task, whatever its length."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"),
                               F.when(~is_missing(df, c), F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), F.col(c)).alias("b")))
                               .alias("value")) for c in cols])
    values = df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull())
    return values.distinct().groupBy("column_name").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_distinct"))


#: Bytes of a value, in sevens, that go along with its hash to settle ties of counts.
HEADS = 4


def _heads(value: Column) -> list[Column]:
    """The first bytes of a string as numbers that together sort as the string does."""
    return [F.conv(F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 7 * i + 1, 7)), 14, F.lit("0")), 16, 10).cast("bigint")
            for i in range(HEADS)]


def categorical_profile(df: DataFrame, columns: list[str] | None = None,
                        top: int = 5) -> DataFrame:
    """A2: distinct count and the top values (count desc, value asc) per column.

    Pass 1 counts by a 128-bit hash of the value, beside its first 28 bytes: no text is
    shuffled, and the counts are fixed-width, so a hot value collapses in a hash map inside
    its map task. By (count, first bytes) the first ``top`` and all that tie with the last of
    them are candidates; pass 2 fetches the candidates' texts only, which settle the ties."""
    cols = columns or other_columns(df)
    key = ["column_name", "a", "b"]
    values = _unpivot_values(df, cols).select(
        "column_name", F.xxhash64("value").alias("a"), F.xxhash64(F.lit(1), F.col("value")).alias("b"), "value")
    heads = [f"head{i}" for i in range(HEADS)]
    counts = materialize(values.groupBy(*key).agg(
        F.count(F.lit(1)).alias("cnt"), *[F.max(h).alias(c) for c, h in zip(heads, _heads(F.col("value")))]))
    # rank() <= k is planned as a partial WindowGroupLimit: each task keeps its own candidates
    w = Window.partitionBy("column_name").orderBy(F.desc("cnt"), *heads)
    candidates = counts.withColumn("r", F.rank().over(w)).where(F.col("r") <= top).select(*key, "cnt")
    # the set of a candidate's texts has one member and, unlike first(), a hash aggregate
    texts = (values.join(bounded_broadcast(candidates), key).groupBy(*key)
                   .agg(F.max("cnt").alias("cnt"), F.collect_set("value")[0].alias("value")))
    w = Window.partitionBy("column_name").orderBy(F.desc("cnt"), F.asc("value"))
    topk = texts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    nd = counts.groupBy("column_name").agg(F.count(F.lit(1)).cast("bigint").alias("n_distinct"))
    return topk.join(F.broadcast(nd), "column_name").select(       # a row per column
        "column_name", "n_distinct", F.col("rank").cast("bigint").alias("rank"),
        "value", F.col("cnt").cast("bigint").alias("cnt"))


def _missing_agg(df: DataFrame, cols: list[str]) -> DataFrame:
    structs = [F.struct(F.lit(c).alias("column_name"),
                        F.count_if(is_missing(df, c)).cast("bigint").alias("missing_count"))
               for c in cols]
    complete = F.lit(True)
    for c in cols:
        complete = complete & ~is_missing(df, c)
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.count_if(complete).alias("complete_rows"),
                  F.array(*structs).alias("a"))


def missing_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A3: columns with any missing value, count and percent (2 decimals)."""
    cols = columns or df.columns
    agg = _missing_agg(df, cols)
    return (agg.select("total_rows", F.explode("a").alias("s"))
               .select("s.column_name", "s.missing_count",
                       r2(F.col("s.missing_count") / F.col("total_rows") * 100).alias("missing_pct"),
                       F.col("total_rows").cast("bigint").alias("total_rows"))
               .where(F.col("missing_count") > 0))


def complete_row_count(df: DataFrame) -> DataFrame:
    """A4: rows without any missing value (same single aggregate as A3)."""
    return _missing_agg(df, df.columns).select(
        F.col("total_rows").cast("bigint"), F.col("complete_rows").cast("bigint"))


def target_distribution(df: DataFrame, target: str, *, approx: bool = False,
                        accuracy: int = 10000) -> DataFrame:
    """A5 (alias ``class_balance``)."""
    y = clean(df, target).cast("double")
    src = df.select(y.alias("y"))
    y = F.col("y")
    ps = [0.25, 0.5, 0.75, 0.9, 0.95]
    if approx:
        q = _approx_quantiles(y, ps, accuracy)
    else:
        qrow = exact_quantiles(src, ["y"], ps).agg(F.first("q").alias("__q"))
        src = src.crossJoin(F.broadcast(qrow))       # one row
        q = F.first("__q")
    return src.agg(
        F.lit(target).alias("target_column"),
        r4(F.avg(y)).alias("mean"), r4(q[1]).alias("median"), r4(F.stddev_samp(y)).alias("std"),
        F.min(y).alias("min"), F.max(y).alias("max"), r4(sample_skew(y)).alias("skew"),
        r2(F.count_if(y == 0) / F.count(F.lit(1)) * 100).alias("pct_zero"),
        r2(q[0]).alias("p25"), r2(q[1]).alias("p50"), r2(q[2]).alias("p75"),
        r2(q[3]).alias("p90"), r2(q[4]).alias("p95"))


class_balance = target_distribution


def _corr_row(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    y = clean(df, target).cast("double")
    structs = [F.struct(F.lit(c).alias("column_name"),
                        safe_corr(clean(df, c).cast("double"), y).alias("corr"))
               for c in cols]
    return df.agg(F.array(*structs).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def target_correlation(df: DataFrame, target: str, top_n: int = 10) -> DataFrame:
    """Top-n numeric features by |r| with the target, signed r (4 decimals).

    Runs on the p one-row results only, so the global order is on p rows.
    """
    cols = numeric_columns(df, exclude=(target,))
    long = _corr_row(df, target, cols).where(F.col("corr").isNotNull())
    w = Window.orderBy(F.desc(F.abs("corr")), F.asc("column_name"))
    return (long.withColumn("rank", F.row_number().over(w).cast("bigint"))
                .where(F.col("rank") <= top_n)
                .select("column_name", r4(F.col("corr")).alias("corr"), "rank"))


def factorize_target(df: DataFrame, target: str, order_by: str) -> DataFrame:
    """Codes by first appearance (order given by ``order_by``), NULL → -1.

    The ranking window runs over the distinct values only (one row each).
    """
    firsts = (df.where(F.col(target).isNotNull())
                .groupBy(F.col(target).cast("string").alias("value"))
                .agg(F.min(order_by).alias("first_seen")))
    from tablekit.functions.joins import dense_index
    return dense_index(firsts, ["first_seen", "value"], "code").select("value", "code")


def factorize_apply(df: DataFrame, target: str, codes: DataFrame) -> DataFrame:
    return (df.join(bounded_broadcast(codes), F.col(target).cast("string") == F.col("value"), "left")
              .withColumn(target + "_code", F.coalesce(F.col("code"), F.lit(-1).cast("bigint")))
              .drop("value", "code"))


#: Numeric columns up to which pairs with an infinite value are shown (r = NaN).
PAIR_COLUMNS = 24


def multicollinear_pairs(df: DataFrame, target: str | None = None,
                         threshold: float = 0.9) -> DataFrame:
    """All feature pairs (i < j in schema order) with |r| > threshold.

    Co-moment matrices are added up in one scan, as three aggregates per pair would cost each
    row more than reading it. A pair with an infinite value has r = NaN, above any threshold."""
    cols = numeric_columns(df, exclude=(target,) if target else ())
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, corr double")
    r = F.abs(pair_correlation())
    if len(cols) <= PAIR_COLUMNS:
        r = F.when(F.isnan(F.col("cxx") + F.col("cyy") + F.col("cxy")), F.lit(float("nan"))).otherwise(r)
    name = F.array(*map(F.lit, cols))
    return (co_moments(df.select(*[clean(df, c).cast("double").alias(c) for c in cols]), cols)
            .select(name[F.col("i")].alias("col1"), name[F.col("j")].alias("col2"), r.alias("r"))
            .where(F.col("r") > threshold).select("col1", "col2", r4(F.col("r")).alias("corr")))


def iqr_fences(df: DataFrame, cols: list[str], *, approx: bool = False,
               accuracy: int = 10000, k: float = 1.5) -> DataFrame:
    """One row: per column a struct(lo, hi) of the k·IQR fences."""
    if approx:
        fields = []
        for c in cols:
            q = _approx_quantiles(clean(df, c).cast("double"), [0.25, 0.75], accuracy)
            fields.append(F.struct((q[0] - k * (q[1] - q[0])).alias("lo"),
                                   (q[1] + k * (q[1] - q[0])).alias("hi")).alias(c))
        return df.agg(*fields)
    q = exact_quantiles(df, cols, [0.25, 0.75])
    q1, q3 = F.col("q")[0], F.col("q")[1]
    fence = F.struct((q1 - k * (q3 - q1)).alias("lo"), (q3 + k * (q3 - q1)).alias("hi"))
    return q.agg(*[F.first(F.when(F.col("column_name") == c, fence), ignorenulls=True).alias(c)
                   for c in cols])


def iqr_outliers(df: DataFrame, columns: list[str] | None = None, *,
                 approx: bool = False) -> DataFrame:
    """Per numeric column, rows outside the 1.5·IQR fences (only count > 0).

    Pass 1 computes the fences (one row); pass 2 joins that single row to
    every row (a broadcast of one row, size fixed) and counts in one aggregate.
    """
    cols = columns or numeric_columns(df)
    fences = iqr_fences(df, cols, approx=approx).select(
        *[F.col(c).alias("__f_" + c) for c in cols])
    j = df.select(*[clean(df, c).cast("double").alias(c) for c in cols]).crossJoin(
        F.broadcast(fences))
    structs = []
    for c in cols:
        lo, hi = F.col(f"__f_{c}.lo"), F.col(f"__f_{c}.hi")
        structs.append(F.struct(
            F.lit(c).alias("column_name"),
            F.count_if((F.col(c) < lo) | (F.col(c) > hi)).cast("bigint").alias("outlier_count"),
            F.first(lo).alias("lo"), F.first(hi).alias("hi")))
    out = j.agg(F.count(F.lit(1)).alias("n"), F.array(*structs).alias("a"))
    return (out.select("n", F.explode("a").alias("s"))
               .select("s.column_name", "s.outlier_count",
                       r2(F.col("s.outlier_count") / F.col("n") * 100).alias("outlier_pct"),
                       r4(F.col("s.lo")).alias("lower_fence"), r4(F.col("s.hi")).alias("upper_fence"))
               .where(F.col("outlier_count") > 0))


def encoding_recommendation(df: DataFrame, target: str | None = None) -> DataFrame:
    """A10: per column, a recommended encoding from type and distinct count."""
    from pyspark.sql import types as T
    kinds = {}
    for f in df.schema.fields:
        if f.name == target:
            continue
        if isinstance(f.dataType, T.StringType):
            kinds[f.name] = "string"
        elif isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType,
                                     T.FloatType, T.DoubleType)):
            kinds[f.name] = "number"
    cols = list(kinds)
    kind_df = df.sparkSession.createDataFrame(list(kinds.items()), "column_name string, kind string")
    nd = distinct_counts(df, cols)
    n = F.col("n_distinct")
    rec = (F.when(F.col("kind") == "string",
                  F.when(n <= 20, "one_hot_encode").otherwise("label_encode_or_drop"))
            .otherwise(F.when(n <= 10, "treat_as_categorical_or_keep").otherwise("scale_numeric")))
    return (F.broadcast(kind_df).join(nd, "column_name", "left")
            .select("column_name", F.coalesce(n, F.lit(0).cast("bigint")).alias("n_distinct"),
                    rec.alias("recommendation")))


def zero_inflation(df: DataFrame, target: str, threshold: float = 0.15) -> DataFrame:
    """Fraction of exact zeros; above the threshold a two-stage model is advised."""
    y = clean(df, target)
    frac = F.avg((y == 0).cast("double"))
    return df.agg(r4(frac).alias("pct_zero"), (frac > threshold).alias("two_stage_recommended"))


def log_target_rule(df: DataFrame, target: str) -> DataFrame:
    """Skew > 1 and min >= 0 → log1p the target."""
    y = clean(df, target).cast("double")
    sk = sample_skew(y)
    return df.agg(r4(sk).alias("skew"), F.min(y).alias("min"),
                  ((sk > 1) & (F.min(y) >= 0)).alias("apply_log"))


def high_cardinality(df: DataFrame, threshold: int = 10, exclude=()) -> DataFrame:
    """Non-numeric columns with more than ``threshold`` distinct values."""
    cols = other_columns(df, exclude=exclude)
    return distinct_counts(df, cols).where(F.col("n_distinct") > threshold)


def feature_summary(df: DataFrame, target: str) -> DataFrame:
    """One row describing the prepared feature table.

    ``df`` is the output of ``prepare_table`` plus the target column.
    """
    feats = [c for c in df.columns if c != target]
    num = numeric_columns(df, exclude=(target,))
    cat = [c for c in feats if c not in num]
    hc = high_cardinality(df.select(*cat), 10) if cat else None
    y = clean(df, target).cast("double")
    base = df.agg(F.count(F.lit(1)).alias("n_samples"),
                  r4(F.avg((y == 0).cast("double"))).alias("pct_zero"),
                  r4(sample_skew(y)).alias("skew"), F.min(y).alias("y_min"))
    row = base.select(
        F.col("n_samples").cast("bigint"), F.lit(len(feats)).cast("bigint").alias("n_features"),
        F.lit(",".join(num)).alias("numeric_columns"),
        F.lit(",".join(cat)).alias("categorical_columns"),
        "pct_zero", (F.col("pct_zero") > 0.15).alias("two_stage_recommended"), "skew",
        ((F.col("skew") > 1) & (F.col("y_min") >= 0)).alias("log_transform"))
    if hc is None:
        return row.withColumn("high_cardinality", F.lit(""))
    hcl = hc.agg(F.array_join(F.array_sort(F.collect_list("column_name")), ",")
                 .alias("high_cardinality"))
    return row.crossJoin(hcl)


def full_profile(df: DataFrame, target: str) -> DataFrame:
    """Every profile as one long table (section, column_name, stat, value, label).

    The input is materialised once so the sections share a single scan.
    """
    src = materialize(df)
    num = numeric_profile(src)
    stats = ["mean", "std", "min", "p25", "p50", "p75", "max", "skew", "kurtosis"]
    parts = [num.select(F.lit("numeric").alias("section"), "column_name",
                        F.explode(F.array(*[F.struct(F.lit(s).alias("stat"),
                                                     F.col(s).alias("value"))
                                            for s in stats])).alias("kv"))
                .select("section", "column_name", "kv.stat", "kv.value",
                        F.lit(None).cast("string").alias("label"))]
    cat_cols = other_columns(src)
    if cat_cols:
        cp = categorical_profile(src, cat_cols)
        parts.append(cp.select(F.lit("categorical").alias("section"), "column_name",
                               F.concat(F.lit("top"), F.col("rank").cast("string")).alias("stat"),
                               F.col("cnt").cast("double").alias("value"),
                               F.col("value").alias("label")))
    mr = missing_report(src)
    parts.append(mr.select(F.lit("missing").alias("section"), "column_name",
                           F.lit("missing_pct").alias("stat"), F.col("missing_pct").alias("value"),
                           F.lit(None).cast("string").alias("label")))
    td = target_distribution(src, target)
    tstats = ["mean", "median", "std", "min", "max", "skew", "pct_zero", "p25", "p50", "p75", "p90", "p95"]
    parts.append(td.select(F.lit("target").alias("section"), F.col("target_column").alias("column_name"),
                           F.explode(F.array(*[F.struct(F.lit(s).alias("stat"),
                                                        F.col(s).cast("double").alias("value"))
                                               for s in tstats])).alias("kv"))
                   .select("section", "column_name", "kv.stat", "kv.value",
                           F.lit(None).cast("string").alias("label")))
    tc = target_correlation(src, target)
    parts.append(tc.select(F.lit("correlation").alias("section"), "column_name",
                           F.lit("corr").alias("stat"), F.col("corr").alias("value"),
                           F.lit(None).cast("string").alias("label")))
    oc = iqr_outliers(src)
    parts.append(oc.select(F.lit("outliers").alias("section"), "column_name",
                           F.lit("outlier_pct").alias("stat"), F.col("outlier_pct").alias("value"),
                           F.lit(None).cast("string").alias("label")))
    mp = multicollinear_pairs(src, target)
    parts.append(mp.select(F.lit("collinear").alias("section"), F.col("col1").alias("column_name"),
                           F.lit("corr").alias("stat"), F.col("corr").alias("value"), F.col("col2").alias("label")))
    cr = complete_row_count(src)
    parts.append(cr.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("stat"), v.cast("double").alias("value")) for n, v in
        (("total_rows", F.col("total_rows")), ("complete_rows", F.col("complete_rows")),
         ("columns", F.lit(len(src.columns))))])).alias("kv")).select(
            F.lit("shape").alias("section"), F.lit(None).cast("string").alias("column_name"), "kv.stat", "kv.value",
            F.lit(None).cast("string").alias("label")))
    er = encoding_recommendation(src, target)
    parts.append(er.select(F.lit("encoding").alias("section"), "column_name",
                           F.lit("n_distinct").alias("stat"),
                           F.col("n_distinct").cast("double").alias("value"),
                           F.col("recommendation").alias("label")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
