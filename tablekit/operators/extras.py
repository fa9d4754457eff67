"""Feature and evaluation recipes the reference's knowledge text recommends
but does not compute (D1-D18). Ordinary Spark jobs over the same building
blocks; ranks and quantile buckets use the distributed position helpers, not
a window over a whole table or group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablekit.functions.joins import (bounded_broadcast, dense_index, group_positions,
                                      materialize)
from tablekit.functions.quantiles import value_counts_ranged, value_quantiles
from tablekit.functions.stats import clean, numeric_columns
from tablekit.operators.profile import iqr_fences


def frequency_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Category → its row count (size-checked broadcast of the counts)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).cast("bigint").alias(out or f"{col}_freq"))
    return df.join(bounded_broadcast(counts), col, "left")


def winsorize(df: DataFrame, cols: list[str], k: float = 3.0) -> DataFrame:
    """Clip each column to its k·IQR fences (one row, broadcast)."""
    j = df.crossJoin(F.broadcast(iqr_fences(df, cols, k=k).select(*[F.col(c).alias("__q_" + c) for c in cols])))
    sel = []
    for c in df.columns:
        if c in cols:
            x = clean(df, c)
            sel.append(F.when(x.isNotNull(), F.greatest(F.col(f"__q_{c}.lo"), F.least(x, F.col(f"__q_{c}.hi")))).alias(c))
        else:
            sel.append(F.col(c))
    return j.select(*sel)


def zscore_flags(df: DataFrame, cols: list[str], z: float = 3.0) -> DataFrame:
    """Per column, rows with |x − mean| / std > z (sample std)."""
    st = df.agg(*[x for c in cols for x in (F.avg(clean(df, c)).alias("__m_" + c),
                                            F.stddev_samp(clean(df, c)).alias("__s_" + c))])
    j = df.crossJoin(F.broadcast(st))
    structs = [F.struct(F.lit(c).alias("column_name"),
                        F.count_if(F.abs(clean(df, c) - F.col("__m_" + c)) / F.col("__s_" + c) > z)
                        .cast("bigint").alias("n_outliers")) for c in cols]
    return j.agg(F.array(*structs).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def near_constant(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.01) -> DataFrame:
    """D3: coefficient of variation std / |mean| below the threshold."""
    cols = cols or numeric_columns(df)
    structs = [F.struct(F.lit(c).alias("column_name"),
                        F.try_divide(F.stddev_samp(clean(df, c)), F.abs(F.avg(clean(df, c)))).alias("cv"))
               for c in cols]
    a = df.agg(F.array(*structs).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    return a.where(F.col("cv") < threshold).select("column_name", F.round("cv", 6).alias("cv"))


def _ranked(counts: DataFrame) -> DataFrame:
    """Average ranks of the values of ``value_counts_ranged`` rows (keys, ``value``, ``c``,
    ``pid``; key ``column_name``): ties share the mean of their positions. ``rank`` is taken
    from the middle of the column's ranks, so that sums of its products do not cancel."""
    totals = counts.groupBy("column_name", "pid").agg(F.sum("c").alias("t"))
    by = Window.partitionBy("column_name")
    before = by.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    # a row per column and partition
    totals = totals.select("column_name", "pid", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("off"),
                           F.sum("t").over(by).alias("n"))
    up = Window.partitionBy("column_name", "pid").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("off") + F.col("end")
    return (counts.withColumn("end", F.sum("c").over(up)).join(totals, ["column_name", "pid"])
                  .withColumn("rank", end - (F.col("c") - 1) / 2 - (F.col("n") + 1) / 2)
                  .drop("end", "off", "n", "pid"))


def spearman_leakage(df: DataFrame, target: str, key: str, threshold: float = 0.9) -> DataFrame:
    """Spearman ρ (Pearson of average ranks over the rows that hold both) of each numeric
    feature with the target; |ρ| > threshold flagged. Values are compared as doubles.

    The shuffles do not depend on the number of columns. The target's ranks are joined to the
    rows; then one grouping by (column, value) counts each value and adds up the target's
    ranks beside it, so a hot value collapses in its map task, and the values' own ranks come
    from one range partitioning of these groups: all of a group's rows share its rank."""
    feats = numeric_columns(df, exclude=(target, key))
    src = df.select(clean(df, target).cast("double").alias("__y"), *[clean(df, c).cast("double").alias(c) for c in feats])
    ys = value_counts_ranged(src.select(F.lit(target).alias("column_name"), F.col("__y").alias("value")), ["column_name"])
    ranks = _ranked(ys).select(F.col("value").alias("__v"), F.col("rank").alias("__ry"))
    j = src.join(bounded_broadcast(ranks), F.col("__y") == F.col("__v"), "left")
    long = j.select("__ry", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("value")) for c in feats])).alias("s"))
    y = F.col("__ry")
    groups = long.select("s.*", "__ry").where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("c"), F.count(y).alias("both"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"),
        F.min(y).alias("least"), F.max(y).alias("most"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(groups.repartitionByRange(n, "column_name", "value").withColumn("pid", F.spark_partition_id()))
    x, k = F.col("rank"), F.col("both")
    sums = _ranked(ranged).where(k > 0).groupBy("column_name").agg(
        F.sum(k).alias("n"), F.sum(k * x).alias("x"), F.sum(k * x * x).alias("xx"), F.sum("sy").alias("y"),
        F.sum("syy").alias("yy"), F.sum(x * F.col("sy")).alias("xy"),
        ((F.min(x) < F.max(x)) & (F.min("least") < F.max("most"))).alias("vary"))
    xx, yy = (F.col(c + c) - F.col(c) * F.col(c) / F.col("n") for c in "xy")
    rho = F.when(F.col("vary"), (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(xx * yy))
    names = df.sparkSession.createDataFrame([(c,) for c in feats], "column_name string")
    return names.join(F.broadcast(sums), "column_name", "left").select(       # a row per column
        "column_name", F.round(rho, 4).alias("rho"), (F.abs(rho) > threshold).alias("leakage_suspect"))


def group_features_full(df: DataFrame, group_col: str, cols: list[str],
                        approx: bool = False) -> DataFrame:
    """Per group mean, sample std, min, max, median of each column, joined back. Medians
    come from value counts spread over partitions, so a hot group is in no single buffer."""
    aggs = []
    for c in cols:
        x = clean(df, c)
        aggs += [F.avg(x).alias(f"{group_col}__{c}_mean"), F.stddev_samp(x).alias(f"{group_col}__{c}_std"),
                 F.min(x).alias(f"{group_col}__{c}_min"), F.max(x).alias(f"{group_col}__{c}_max")]
        if approx:
            aggs.append(F.percentile_approx(x, 0.5, 10000).cast("double").alias(f"{group_col}__{c}_median"))
    known = df.where(F.col(group_col).isNotNull())
    stats = known.groupBy(group_col).agg(*aggs)
    if not approx:
        u = known.select(F.col(group_col).alias("__g"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), clean(df, c).cast("double").alias("value")) for c in cols])).alias("s"))
        q = value_quantiles(u.select("__g", "s.*"), ["__g", "column_name"], [0.5])
        medians = q.groupBy("__g").agg(*[
            F.first(F.when(F.col("column_name") == c, F.col("q")[0]), ignorenulls=True).alias(f"{group_col}__{c}_median")
            for c in cols])
        stats = stats.join(medians, F.col(group_col) == F.col("__g"), "left").drop("__g")
        order = [group_col, *[f"{group_col}__{c}_{m}" for c in cols for m in ("mean", "std", "min", "max", "median")]]
        stats = stats.select(*order)
    return df.join(bounded_broadcast(stats), group_col, "left")


def rank_in_group(df: DataFrame, group_col: str, col: str, key: str) -> DataFrame:
    """Row number (ties by key), rank (ties share the lowest) and percent
    rank of ``col`` inside its group — distributed positions, so a group
    holding a third of the rows is still spread over many tasks."""
    pos = group_positions(df, [group_col], [col, key], "__p")
    first = pos.groupBy(group_col, col).agg(F.min("__p").alias("__first"))
    sizes = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("__n"))
    out = pos.join(first, [group_col, col]).join(sizes, group_col)
    return out.select(*df.columns, (F.col("__p") + 1).alias("row_number"),
                      (F.col("__first") + 1).alias("rank"),
                      F.when(F.col("__n") > 1, F.col("__first") / (F.col("__n") - 1))
                       .otherwise(F.lit(0.0)).alias("percent_rank"))


def micro_market(df: DataFrame, vector_col: str, k: int = 8, seed: int = 42,
                 out: str = "cluster") -> DataFrame:
    """K-means clusters of a vector column (``ml.clustering.KMeans``)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    v = df.withColumn("__vec", array_to_vector(F.col(vector_col).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="__vec", predictionCol=out).fit(v)
    return model.transform(v).drop("__vec")


def grid_cell(df: DataFrame, lat: str, lon: str, delta: float, out: str = "cell") -> DataFrame:
    """D7 (grid form): cell id from floored coordinates."""
    return df.withColumn(out, F.concat_ws(":", F.floor(F.col(lat) / delta).cast("string"),
                                          F.floor(F.col(lon) / delta).cast("string")))


def interactions(df: DataFrame, cols: list[str], limit: int | None = None) -> DataFrame:
    """Products and ratios of all column pairs (i < j), or of the first ``limit`` ones."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]][:limit]
    extra = []
    for a, b in pairs:
        extra += [(F.col(a) * F.col(b)).alias(f"{a}_x_{b}"),
                  F.try_divide(F.col(a), F.col(b)).alias(f"{a}_per_{b}")]
    return df.select("*", *extra)


def calendar_extras(df: DataFrame, col: str, prefix: str | None = None,
                    peak_months: tuple[int, ...] = (6, 7, 8)) -> DataFrame:
    """Day of year, ISO week, peak-season flag."""
    p = prefix or col
    ts = F.col(col).cast("timestamp")
    return df.select("*", F.dayofyear(ts).alias(f"{p}_dayofyear"), F.weekofyear(ts).alias(f"{p}_week"),
                     F.month(ts).isin(*peak_months).cast("int").alias(f"{p}_peak_season"))


def weighted_ensemble(preds: DataFrame, pred_cols: list[str], mses: list[float],
                      out: str = "prediction") -> DataFrame:
    """1/MSE-weighted mean of member predictions (``model.out_of_fold`` gives these, and
    ``model.member_errors`` their errors)."""
    w = [1.0 / m for m in mses]
    tot = sum(w)
    expr = sum((F.col(c) * (wi / tot) for c, wi in zip(pred_cols, w)), F.lit(0.0))
    return preds.withColumn(out, expr)


def stacking(oof: DataFrame, pred_cols: list[str], label: str) -> DataFrame:
    """Ridge on out-of-fold member predictions (``model.out_of_fold``); returns (member, weight)."""
    from tablekit.operators.model import fit_stack
    m = fit_stack(oof, label, pred_cols).models[0]
    rows = [(c, float(v)) for c, v in zip(pred_cols, m.coefficients.toArray())]
    rows.append(("intercept", float(m.intercept)))
    return oof.sparkSession.createDataFrame(rows, "member string, weight double")


def cv_instability(results: DataFrame, ratio: float = 0.2) -> DataFrame:
    """Std of the fold MSE above ``ratio`` of its mean."""
    return results.select("model", "cv_mse_mean", "cv_mse_std",
                          (F.col("cv_mse_std") > ratio * F.col("cv_mse_mean")).alias("unstable"))


def ntile_positions(pos: F.Column, n: F.Column, k: int) -> F.Column:
    """``ntile(k)`` from a 0-based position among n rows: the first n % k buckets
    hold one row more."""
    q = F.floor(n / k)
    r = n % k
    big = r * (q + 1)
    return (F.when(pos < big, F.floor(pos / (q + 1)))
             .otherwise(r + F.floor((pos - big) / F.greatest(q, F.lit(1)))) + 1).cast("int")


def time_ordered_split(df: DataFrame, ts: str, key: str, k: int = 5, out: str = "time_fold") -> DataFrame:
    """K time-ordered buckets (ntile over time, ties by key); fold f trains
    on buckets < f and validates on f (expanding window)."""
    idx = dense_index(df, [ts, key], "__pos")
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    return (idx.crossJoin(F.broadcast(n))
               .withColumn(out, ntile_positions(F.col("__pos"), F.col("__n"), k))
               .drop("__pos", "__n"))


def residual_profile(df: DataFrame, label: str, pred: str, key: str, k: int = 10) -> DataFrame:
    """Mean and population variance of residuals per prediction decile."""
    d = time_ordered_split(df, pred, key, k, "decile")
    res = F.col(label) - F.col(pred)
    return d.groupBy("decile").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                   F.round(F.avg(res), 4).alias("mean_residual"),
                                   F.round(F.var_pop(res), 4).alias("var_residual"))


def unseen_categories(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    """Per column, distinct test values and test rows not seen in train."""
    parts = []
    for c in cols:
        seen = train.select(F.col(c).cast("string").alias("__v")).where("__v is not null").distinct()
        t = test.select(F.col(c).cast("string").alias("__v")).where("__v is not null")
        un = t.join(seen, "__v", "left_anti")
        parts.append(un.agg(F.lit(c).alias("column_name"),
                            F.count_distinct("__v").cast("bigint").alias("n_unseen_values"),
                            F.count(F.lit(1)).cast("bigint").alias("n_unseen_rows")))
    return reduce(DataFrame.unionByName, parts)


def type_consistency(train: DataFrame, test: DataFrame) -> DataFrame:
    """Common columns whose kind differs between the tables (schema only)."""
    from tablekit.operators.validate import schema_diff
    d = schema_diff(train, test, "__none__").where(F.col("status") == "both")
    return d.select("column_name", "train_kind", "test_kind",
                    (F.col("train_kind") == F.col("test_kind")).alias("consistent"))


def collinear_drop(df: DataFrame, target: str, threshold: float = 0.9) -> DataFrame:
    """For each feature pair with |r| > threshold, drop the one with the
    lower |r| with the target (ties: the later column)."""
    from tablekit.operators.profile import _corr_row, multicollinear_pairs
    pairs = multicollinear_pairs(df, target, threshold)
    tr = _corr_row(df, target, numeric_columns(df, exclude=(target,))).select(
        "column_name", F.abs("corr").alias("r"))
    a, b = tr.alias("a"), tr.alias("b")
    j = (pairs.join(a, F.col("col1") == F.col("a.column_name"))
              .join(b, F.col("col2") == F.col("b.column_name")))
    drop = F.when(F.col("a.r") < F.col("b.r"), F.col("col1")).otherwise(F.col("col2"))
    return j.select("col1", "col2", drop.alias("drop_column"))


def rmsle(df: DataFrame, label: str, pred: str = "prediction") -> DataFrame:
    """Root mean squared log error."""
    e = F.log1p(F.col(pred)) - F.log1p(F.col(label))
    return df.agg(F.round(F.sqrt(F.avg(e * e)), 4).alias("rmsle"))


def permutation_importance(df: DataFrame, score_fn, label: str, features: list[str],
                           key: str, seed: int = 42) -> DataFrame:
    """Per feature, increase of the mean squared error when its column is permuted.

    Row i takes the value of the row at the same position in an md5 order of the (unique)
    keys: one positional join carries all permuted columns. Each row is then scored once as it
    is and once per feature, in one pass with one aggregate; ``score_fn`` adds
    ``prediction`` and keeps the other columns."""
    a = dense_index(df, [key], "__i")
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))
    b = dense_index(df.select(F.col(key), h.alias("__h"), *[F.col(c).alias(f"__p_{c}") for c in features]), ["__h", key], "__i")
    j = a.join(b.select("__i", *[f"__p_{c}" for c in features]), "__i")
    copies = j.select("*", F.explode(F.array(F.lit(None).cast("string"), *map(F.lit, features))).alias("__f"))
    kept = [F.when(F.col("__f") == c, F.col(f"__p_{c}")).otherwise(F.col(c)).alias(c) if c in features else F.col(c)
            for c in df.columns]
    e = F.col("prediction") - F.col(label)
    per = score_fn(copies.select(*kept, "__f")).groupBy("__f").agg(F.avg(e * e).alias("mse"))
    # a row per feature
    base = F.max(F.when(F.col("__f").isNull(), F.col("mse"))).over(Window.partitionBy(F.lit(0)))
    return (per.select(F.col("__f").alias("feature"), F.round(F.col("mse") - base, 4).alias("mse_increase"))
               .where(F.col("feature").isNotNull()))


def polynomial_features(df: DataFrame, cols: list[str], degree: int = 2,
                        out: str = "poly") -> DataFrame:
    """Degree-2 expansion (``ml.feature.PolynomialExpansion``) of the columns."""
    from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
    v = VectorAssembler(inputCols=cols, outputCol="__v", handleInvalid="keep").transform(df)
    return PolynomialExpansion(degree=degree, inputCol="__v", outputCol=out).transform(v).drop("__v")
