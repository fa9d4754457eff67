"""Projections, filters and feature builders.

Fit/transform pairs: a fit computes a small statistics table (one row, or one
row per category) on the training table; the transform is a projection or a
join against that table. Joins broadcast only a side whose size is bounded by
construction (≤ 50 groups) or checked (``bounded_broadcast``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekit.functions.joins import bounded_broadcast, dense_index, materialize
from tablekit.functions.stats import (clean, clip, days_between, fold_of,
                                      is_missing, numeric_columns,
                                      other_columns)

# Defaults of the reference's preparation steps.
DEFAULT_ID_COLUMNS = ["name", "_id", "host_name"]
DEFAULT_DATE_COLUMN = "last_dt"
DEFAULT_REFERENCE_DATE = "2019-12-31"
DEFAULT_CLIP = (0.0, 365.0)
TARGET_SMOOTHING = 20.0
N_FOLDS = 5

# ---------------------------------------------------------------------------
# P: projections, filters, predicates
# ---------------------------------------------------------------------------


def drop_columns(df: DataFrame, cols: list[str] = (), target: str | None = None) -> DataFrame:
    """features = table − drop list − target (absent names ignored)."""
    return df.drop(*[c for c in list(cols) + ([target] if target else []) if c in df.columns])


def drop_id_columns(df: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Drop identifier columns (default list of the reference)."""
    return df.drop(*[c for c in (ids or DEFAULT_ID_COLUMNS) if c in df.columns])


def split_by_type(df: DataFrame) -> DataFrame:
    """(column_name, kind) with kind numeric / categorical — schema only."""
    num = set(numeric_columns(df))
    rows = [(f.name, "numeric" if f.name in num else "categorical") for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, kind string")


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Presence check before a job runs; one row per requested column."""
    have = set(df.columns)
    rows = [(c, c in have, None if c in have else f"column '{c}' not found") for c in cols]
    return df.sparkSession.createDataFrame(rows, "column_name string, present boolean, reason string")


def assert_columns(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; available: {df.columns}")


def filter_events(events: DataFrame, event_type: str | None = None,
                  agent: str | None = None) -> DataFrame:
    """P5: pushed down as a partition / parquet filter when the log is partitioned."""
    cond = F.lit(True)
    if event_type:
        cond = cond & (F.col("event_type") == event_type)
    if agent:
        cond = cond & (F.col("agent") == agent)
    return events.where(cond)


def filter_by_tag(chunks: DataFrame, tag: str) -> DataFrame:
    """Chunks whose tag list contains ``tag``."""
    return chunks.where(F.array_contains("tags", tag))


def positive_subset(df: DataFrame, target: str) -> DataFrame:
    """Rows with target > 0 (the second stage of a two-stage model)."""
    return df.where(F.col(target) > 0)


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows with no missing value (NaN counts as missing)."""
    cond = F.lit(True)
    for c in df.columns:
        cond = cond & ~is_missing(df, c)
    return df.where(cond)


def clip_range(df: DataFrame, col: str, lo: float = DEFAULT_CLIP[0],
               hi: float = DEFAULT_CLIP[1], out: str | None = None) -> DataFrame:
    """Clip into [lo, hi]; NULL stays NULL."""
    return df.withColumn(out or col, clip(col, lo, hi))


# ---------------------------------------------------------------------------
# F: features
# ---------------------------------------------------------------------------


def date_features(df: DataFrame, col: str = DEFAULT_DATE_COLUMN,
                  reference_date: str = DEFAULT_REFERENCE_DATE,
                  prefix: str = "last_review", cyclical: bool = True) -> DataFrame:
    """F1 (+F2): days since the reference date (floored), year, month, weekday
    (Mon = 0), quarter, weekend flag (0 when NULL), and sin/cos of month and
    weekday; the source column is dropped. Strings are parsed leniently."""
    if col not in df.columns:
        return df
    ts = F.col(col)
    if df.schema[col].dataType.simpleString() == "string":
        ts = F.try_to_timestamp(ts)
    ts = ts.cast("timestamp")
    dow = F.weekday(ts)
    month = F.month(ts)
    cols = [
        days_between(reference_date, ts).alias(f"days_since_{prefix}"),
        F.year(ts).alias(f"{prefix}_year"),
        month.alias(f"{prefix}_month"),
        dow.alias(f"{prefix}_dow"),
        F.quarter(ts).alias(f"{prefix}_quarter"),
        F.coalesce((dow >= 5).cast("int"), F.lit(0)).alias(f"{prefix}_is_weekend"),
    ]
    if cyclical:
        cols += cyclical_columns(month, dow, prefix)
    return df.select(*[c for c in df.columns if c != col], *cols)


def cyclical_columns(month: Column, dow: Column, prefix: str) -> list[Column]:
    """sin/cos of month/12 and weekday/7."""
    two_pi = 2 * math.pi
    return [F.sin(two_pi * month / 12).alias(f"{prefix}_month_sin"),
            F.cos(two_pi * month / 12).alias(f"{prefix}_month_cos"),
            F.sin(two_pi * dow / 7).alias(f"{prefix}_dow_sin"),
            F.cos(two_pi * dow / 7).alias(f"{prefix}_dow_cos")]


def cyclical_features(df: DataFrame, col: str, prefix: str) -> DataFrame:
    ts = F.col(col).cast("timestamp")
    return df.select("*", *cyclical_columns(F.month(ts), F.weekday(ts), prefix))


def fit_missing_indicators(df: DataFrame, threshold: float = 0.01) -> list[str]:
    """F3 fit: columns with more than ``threshold`` missing (one aggregate; the
    result is a column list, i.e. schema-sized)."""
    fr = df.agg(*[F.avg(is_missing(df, c).cast("double")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if fr[c] is not None and fr[c] > threshold]


def apply_missing_indicators(df: DataFrame, cols: list[str]) -> DataFrame:
    """F3 transform: ``<col>_was_missing`` (byte) for the columns fitted on train."""
    return df.select("*", *[is_missing(df, c).cast("byte").alias(f"{c}_was_missing")
                            for c in cols if c in df.columns])


def missing_indicators(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    return apply_missing_indicators(df, fit_missing_indicators(df, threshold))


def choose_group_features(df: DataFrame, target: str | None = None, max_groups: int = 50,
                          n_group_cols: int = 3, n_numeric: int = 3) -> tuple[list[str], list[str]]:
    """F4 fit, part 1: categorical columns with 2 < distinct ≤ 50 (first three in
    schema order) and the three numeric columns of largest sample variance."""
    from tablekit.operators.profile import distinct_counts
    cats = other_columns(df, exclude=(target,) if target else ())
    nums = numeric_columns(df, exclude=(target,) if target else ())
    nd = {r["column_name"]: r["n_distinct"] for r in distinct_counts(df, cats).collect()} if cats else {}
    groups = [c for c in cats if 2 < nd.get(c, 0) <= max_groups][:n_group_cols]
    var = df.agg(*[F.var_samp(clean(df, c)).alias(c) for c in nums]).first() if nums else {}
    ranked = sorted([c for c in nums if var[c] is not None], key=lambda c: (-var[c], nums.index(c)))
    return groups, ranked[:n_numeric]


def group_features(df: DataFrame, target: str | None = None, group_cols: list[str] | None = None,
                   numeric_cols: list[str] | None = None, fit_df: DataFrame | None = None) -> DataFrame:
    """per (group column, numeric column) the group mean and sample std,
    joined back. Groups are ≤ 50 by the fit rule, so the statistics side is
    broadcast; NULL keys get NULL statistics (pandas drops NULL keys)."""
    fit_df = fit_df if fit_df is not None else df
    chosen = group_cols is None
    if group_cols is None or numeric_cols is None:
        g, n = choose_group_features(fit_df, target)
        group_cols = group_cols if group_cols is not None else g
        numeric_cols = numeric_cols if numeric_cols is not None else n
    out = df
    for g in group_cols:
        stats = (fit_df.where(F.col(g).isNotNull()).groupBy(g)
                 .agg(*[x for n in numeric_cols for x in
                        (F.avg(clean(fit_df, n)).alias(f"{g}__{n}_mean"),
                         F.stddev_samp(clean(fit_df, n)).alias(f"{g}__{n}_std"))]))
        # chosen columns have at most 50 groups; given ones are size-checked
        out = out.join(F.broadcast(stats) if chosen else bounded_broadcast(stats), g, "left")
    return out


def _cat_key(c: str) -> Column:
    """Category as a string key; NULL is its own category (pandas ``astype(str)``)."""
    return F.coalesce(F.col(c).cast("string"), F.lit("nan"))


def category_sums(df: DataFrame, cats: list[str], target: str, key: str, k: int = N_FOLDS,
                  fold_col: str | None = None) -> DataFrame:
    """(__column, __cat, __fold, __s, __n): sum and count of the target by category and fold,
    of all columns from one scan, written once."""
    fold = F.col(fold_col) if fold_col else fold_of(F.concat(F.lit("cv-"), F.col(key)), k)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _cat_key(c).alias("cat")) for c in cats]))
    rows = df.select(fold.alias("__fold"), F.col(target).alias("__t"), each.alias("__e"))
    per = rows.groupBy(F.col("__e.column").alias("__column"), F.col("__e.cat").alias("__cat"), "__fold")
    return materialize(per.agg(F.sum("__t").alias("__s"), F.count("__t").alias("__n")))


def _global_mean(sums: DataFrame):
    """Mean of the target from materialised sums (None: no target)."""
    return sums.agg((F.sum("__s") / F.sum("__n")).alias("__gm")).first()["__gm"]


def target_encode_oof(df: DataFrame, cat: str, target: str, key: str, k: int = N_FOLDS,
                      smoothing: float = TARGET_SMOOTHING, fold_col: str | None = None,
                      out: str | None = None, sums: DataFrame | None = None) -> DataFrame:
    """k-fold out-of-fold encoding (n·mean + m·gm)/(n + m) in one shuffle.

    The k passes of the reference collapse into: one aggregate per (category,
    fold) → per category the total minus the own fold (a window over the small
    aggregate, partitioned by category) → join back on (category, fold).
    Unseen in the other folds → n = 0 → the formula gives the global mean.
    ``sums``: ``category_sums`` of several columns, ``cat`` among them.
    """
    out = out or f"{cat}_te"
    fold = F.col(fold_col) if fold_col else fold_of(F.concat(F.lit("cv-"), F.col(key)), k)
    base = df.withColumn("__fold", fold).withColumn("__cat", _cat_key(cat))
    sums = sums if sums is not None else category_sums(df, [cat], target, key, k, fold_col)
    per = sums.where(F.col("__column") == cat)
    w = Window.partitionBy("__cat")
    stats = (per.withColumn("__s_out", F.sum("__s").over(w) - F.col("__s"))
                .withColumn("__n_out", F.sum("__n").over(w) - F.col("__n"))
                .select("__cat", "__fold", "__s_out", "__n_out"))
    stats = bounded_broadcast(stats)
    m, gm = F.lit(float(smoothing)), F.lit(_global_mean(per)).cast("double")
    enc = (F.col("__s_out") + m * gm) / (F.col("__n_out") + m)
    return (base.join(stats, ["__cat", "__fold"], "left")
                .withColumn(out, F.coalesce(enc, gm))
                .drop("__cat", "__fold", "__s_out", "__n_out"))


@dataclass
class TargetEncoding:
    """F6 fit result: per-category smoothed means and the global mean."""
    cat: str
    table: DataFrame          # (__cat, __enc)
    global_mean: DataFrame    # one row (__gm)
    out: str = ""

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.out or f"{self.cat}_te"
        return (df.withColumn("__cat", _cat_key(self.cat))
                  .join(self.table, "__cat", "left").crossJoin(F.broadcast(self.global_mean))
                  .withColumn(out, F.coalesce(F.col("__enc"), F.col("__gm")))
                  .drop("__cat", "__enc", "__gm"))


def fit_target_encoding(train: DataFrame, cat: str, target: str, smoothing: float = TARGET_SMOOTHING,
                        out: str | None = None, sums: DataFrame | None = None) -> TargetEncoding:
    """``sums``: ``category_sums`` of several columns of ``train``, ``cat`` among them."""
    if sums is None:
        base = train.withColumn("__cat", _cat_key(cat))
        sums = materialize(base.groupBy("__cat").agg(F.sum(target).alias("__s"), F.count(target).alias("__n")))
    else:
        sums = sums.where(F.col("__column") == cat).groupBy("__cat").agg(F.sum("__s").alias("__s"), F.sum("__n").alias("__n"))
    m, gm = F.lit(float(smoothing)), F.lit(_global_mean(sums)).cast("double")
    per = sums.select("__cat", ((F.col("__s") + m * gm) / (F.col("__n") + m)).alias("__enc"))
    one_row = train.sparkSession.range(1).select(gm.alias("__gm"))
    return TargetEncoding(cat, bounded_broadcast(per), one_row, out or "")


def target_encode_apply(train: DataFrame, test: DataFrame, cat: str, target: str,
                        smoothing: float = TARGET_SMOOTHING, out: str | None = None) -> DataFrame:
    """encode a scoring table with full-train statistics; unseen → global mean."""
    return fit_target_encoding(train, cat, target, smoothing, out).transform(test)


def fit_medians(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """One row of medians (exact; distributed positions on large inputs)."""
    from tablekit.operators.profile import median_row
    return median_row(df, cols, approx=approx)


def median_impute(df: DataFrame, cols: list[str] | None = None,
                  fit_df: DataFrame | None = None) -> DataFrame:
    """numeric NULL/NaN → median of the fit table (one broadcast row)."""
    fit_df = fit_df if fit_df is not None else df
    cols = cols or numeric_columns(df)
    med = fit_medians(fit_df, cols).select(*[F.col(c).alias("__m_" + c) for c in cols])
    j = df.crossJoin(F.broadcast(med))
    return j.select(*[F.coalesce(clean(df, c), F.col("__m_" + c)).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def mode_of(df: DataFrame, col: str) -> DataFrame:
    """One row: the most frequent non-null value of ``col`` (ties → smallest).

    Counts per value are partially aggregated before the shuffle; the pick is
    a bounded ``min_by`` over the counted values (``mode()`` would keep every
    distinct value of the column in one aggregation buffer)."""
    vc = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    return vc.agg(F.min_by(F.col(col), F.struct((-F.col("__n")).alias("n"), F.col(col).alias("v")))
                  .alias(col))


def fit_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent value per column, ties → smallest value (one row)."""
    out = None
    for c in cols:
        m = mode_of(df, c)
        out = m if out is None else out.crossJoin(m)
    return out


def mode_impute(df: DataFrame, cols: list[str] | None = None,
                fit_df: DataFrame | None = None) -> DataFrame:
    """F8: categorical NULL → most frequent value of the fit table."""
    fit_df = fit_df if fit_df is not None else df
    cols = cols or other_columns(df)
    mo = fit_modes(fit_df, cols).select(*[F.col(c).alias("__m_" + c) for c in cols])
    j = df.crossJoin(F.broadcast(mo))
    return j.select(*[F.coalesce(F.col(c), F.col("__m_" + c)).alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def standard_scale(df: DataFrame, cols: list[str] | None = None,
                   fit_df: DataFrame | None = None) -> DataFrame:
    """(x − mean) / population std; a zero std scales by 1."""
    fit_df = fit_df if fit_df is not None else df
    cols = cols or numeric_columns(df)
    st = fit_df.agg(*[x for c in cols for x in (F.avg(clean(fit_df, c)).alias("__mu_" + c),
                                                F.stddev_pop(clean(fit_df, c)).alias("__sd_" + c))])
    j = df.crossJoin(F.broadcast(st))

    def scaled(c):
        sd = F.when(F.col("__sd_" + c) == 0, F.lit(1.0)).otherwise(F.col("__sd_" + c))
        return ((clean(df, c) - F.col("__mu_" + c)) / sd).alias(c)
    return j.select(*[scaled(c) if c in cols else F.col(c) for c in df.columns])


def fit_ordinal(df: DataFrame, col: str) -> DataFrame:
    """F10 fit: sorted distinct non-null values → 0..k−1, numbered without an
    unpartitioned window (``dense_index``)."""
    vals = df.select(F.col(col).cast("string").alias("__v")).where(F.col("__v").isNotNull()).distinct()
    return dense_index(vals, ["__v"], "__code")


def ordinal_encode(df: DataFrame, cols: list[str] | None = None,
                   fit_df: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """category → its position among the sorted train values; unknown → −1."""
    fit_df = fit_df if fit_df is not None else df
    cols = cols or other_columns(df)
    out = df
    for c in cols:
        codes = bounded_broadcast(fit_ordinal(fit_df, c))
        out = (out.withColumn("__v", F.col(c).cast("string")).join(codes, "__v", "left")
                  .withColumn(c + suffix, F.coalesce(F.col("__code"), F.lit(-1).cast("bigint")))
                  .drop("__v", "__code"))
    return out


def log_target(df: DataFrame, target: str, out: str | None = None) -> DataFrame:
    """log1p of the target."""
    return df.withColumn(out or target, F.log1p(F.col(target)))


def inverse_log(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.expm1(F.col(col)))


def prepare_table(df: DataFrame, target: str | None = None, drop: list[str] = (),
                  date_col: str = DEFAULT_DATE_COLUMN, ids: list[str] | None = None,
                  indicator_cols: list[str] | None = None, threshold: float = 0.01) -> DataFrame:
    """P1 → F1 → P2 → F3 (indicators fitted here unless given)."""
    x = drop_columns(df, drop, target)
    x = date_features(x, date_col)
    x = drop_id_columns(x, ids)
    cols = indicator_cols if indicator_cols is not None else fit_missing_indicators(x, threshold)
    return apply_missing_indicators(x, cols)


@dataclass
class FeatureDecisions:
    """the decision record of the feature step."""
    drop_columns: list[str] = field(default_factory=list)
    encode_columns: list[str] = field(default_factory=list)
    scale_columns: list[str] = field(default_factory=list)
    log_transform_columns: list[str] = field(default_factory=list)
    interaction_features: list[str] = field(default_factory=list)   # "a*b" or "a/b"
    two_stage_recommended: bool = False


def apply_feature_decisions(df: DataFrame, d: FeatureDecisions, target: str | None = None,
                            fit_df: DataFrame | None = None) -> DataFrame:
    """apply every decision as projections and joins (drops, log1p, products
    and ratios, target / ordinal encoding, population scaling)."""
    fit_df = fit_df if fit_df is not None else df
    x = df.drop(*[c for c in d.drop_columns if c in df.columns])
    for c in d.log_transform_columns:
        if c in x.columns:
            x = x.withColumn(c, F.log1p(F.col(c)))
    for spec in d.interaction_features:
        op = "*" if "*" in spec else "/"
        a, b = [s.strip() for s in spec.split(op)]
        if a in x.columns and b in x.columns:
            expr = F.col(a) * F.col(b) if op == "*" else F.try_divide(F.col(a), F.col(b))
            x = x.withColumn(f"{a}{'_x_' if op == '*' else '_per_'}{b}", expr)
    for c in d.encode_columns:
        if c not in x.columns:
            continue
        if target and target in fit_df.columns:
            x = fit_target_encoding(fit_df, c, target, out=c).transform(x)
        else:
            x = ordinal_encode(x, [c], fit_df=fit_df)
    sc = [c for c in d.scale_columns if c in x.columns]
    if sc:
        fit_sc = fit_df
        for c in d.log_transform_columns:
            if c in sc and c in fit_sc.columns:
                fit_sc = fit_sc.withColumn(c, F.log1p(F.col(c)))
        x = standard_scale(x, sc, fit_df=fit_sc)
    return x
