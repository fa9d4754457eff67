"""Validation rules over aggregates (training / scoring tables).

Each rule is one aggregate over the table (or over the schema, which needs no
job) and yields rows of ``(column_name, risk, severity, detail)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions.joins import materialize, stored
from tablekit.functions.stats import (NUMERIC_TYPES, clean, is_missing, r4,
                                      safe_corr, sample_skew)
from tablekit.operators.profile import distinct_counts

FLAG_SCHEMA = "column_name string, risk string, severity string, detail string"

# Name fragments and thresholds of the validation rules.
LEAKAGE_NAME_PATTERNS = ["target", "label", "outcome", "score", "result",
                         "price_final", "final_price", "actual", "ground_truth"]
ID_NAME_PATTERNS = ["id", "_id", "idx", "index", "row_id", "rowid", "record_id", "key"]
MISS_HIGH = 0.80
MISS_WARN = 0.40
CORR_CRITICAL = 0.98
CORR_HIGH = 0.90


def _empty_flags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FLAG_SCHEMA)


def _is_numeric_like(dt) -> bool:
    """pandas ``is_numeric_dtype``: numbers and booleans."""
    return isinstance(dt, NUMERIC_TYPES + (T.BooleanType,))


def _explode(df: DataFrame, structs: list[Column], *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*structs)).alias("s")).select(*keep, "s.*")


def target_checks(df: DataFrame, target: str) -> DataFrame:
    """V1: the fatal checks on the target, as one row with a verdict and reason."""
    if target not in df.columns:
        return df.sparkSession.createDataFrame(
            [(None, None, None, None, False, f"target column '{target}' not found")],
            "n_rows bigint, target_nulls bigint, null_pct double, std double, "
            "can_proceed boolean, reason string")
    raw = F.col(target)
    num = (clean(df, target) if _is_numeric_like(df.schema[target].dataType)
           else F.try_cast(raw.cast("string"), "double"))
    a = df.agg(F.count(F.lit(1)).alias("n"), F.count(raw).alias("n_present"),
               F.count(num).alias("n_num"), F.stddev_samp(num).alias("sd"))
    n, pres, nnum, sd = F.col("n"), F.col("n_present"), F.col("n_num"), F.col("sd")
    null_frac = F.try_divide(n - nnum, n)
    reason = (F.when(n == 0, "train table is empty")
              .when(nnum < pres, "target is not numeric and cannot be coerced")
              .when(nnum == 0, "target column is entirely NaN")
              .when(null_frac > 0.5, F.format_string("target column is %.0f%% NaN", null_frac * 100))
              .when(sd == 0, "target column is constant"))
    return a.select(n.cast("bigint").alias("n_rows"), (n - nnum).cast("bigint").alias("target_nulls"),
                    r4(null_frac).alias("null_pct"), r4(sd).alias("std"),
                    reason.isNull().alias("can_proceed"), reason.alias("reason"))


def target_risk(df: DataFrame, target: str) -> DataFrame:
    """V2: low-cardinality (<= 10 distinct) and high-skew (|G1| > 2) targets."""
    y = clean(df, target).cast("double")
    a = df.select(y.alias("y")).agg(F.count_distinct("y").alias("nu"),
                                    sample_skew(F.col("y")).alias("sk"))
    low = F.struct(F.lit(target).alias("column_name"), F.lit("low_cardinality_target").alias("risk"),
                   F.lit("medium").alias("severity"),
                   F.format_string("only %d unique values - might be classification",
                                   F.col("nu")).alias("detail"),
                   (F.col("nu") <= 10).alias("hit"))
    skew = F.struct(F.lit(target).alias("column_name"), F.lit("high_skew_target").alias("risk"),
                    F.lit("medium").alias("severity"),
                    F.format_string("skewness=%.2f", F.col("sk")).alias("detail"),
                    (F.abs(F.col("sk")) > 2).alias("hit"))
    return _explode(a, [low, skew]).where("hit").drop("hit")


def _kind(dt) -> str:
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.StringType):
        return "string"
    return "other"


def schema_table(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(column_name, kind, position) from the schema — no job."""
    return spark.createDataFrame([(f.name, _kind(f.dataType), i)
                                  for i, f in enumerate(df.schema.fields)],
                                 "column_name string, kind string, position int")


def column_counts(df: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_filled, n_castable) per column from one scan: rows, rows that
    are not null, and rows whose value reads as a number."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(df.columns):
        q = "`" + c.replace("`", "``") + "`"
        aggs += [F.count(F.expr(q)).alias(f"f{i}"), F.count(F.expr(f"try_cast(cast({q} as string) as double)")).alias(f"c{i}")]
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"f{i}").alias("n_filled"),
                                       F.col(f"c{i}").alias("n_castable")) for i, c in enumerate(df.columns)]))
    return df.agg(*aggs).select("n_rows", one.alias("x")).select("x.column_name", "n_rows", "x.n_filled", "x.n_castable")


def with_counts(result: DataFrame, df: DataFrame, prefix: str = "") -> DataFrame:
    """A table with one row per column name, with that column's counts in ``df`` beside it;
    0 for columns that ``df`` does not have."""
    names = ("n_rows", "n_filled", "n_castable")
    c = column_counts(df).select("column_name", *[F.col(x).alias(prefix + x) for x in names])
    return result.join(F.broadcast(c), "column_name", "left").fillna(0, [prefix + x for x in names])  # a row per column


def schema_diff(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """V3: full outer join of the two schema tables.

    status: both / missing_in_test / unexpected_in_test / target_in_test;
    ``critical`` is true on every row when more than half of the train
    features are missing in the test table.
    """
    spark = train.sparkSession
    a = schema_table(spark, train).withColumnRenamed("kind", "train_kind")
    b = schema_table(spark, test).withColumnRenamed("kind", "test_kind")
    j = a.drop("position").join(b.drop("position"), "column_name", "full_outer")
    status = (F.when(F.col("column_name") == target,
                     F.when(F.col("test_kind").isNotNull(), "target_in_test").otherwise("target"))
              .when(F.col("test_kind").isNull(), "missing_in_test")
              .when(F.col("train_kind").isNull(), "unexpected_in_test")
              .otherwise("both"))
    j = j.withColumn("status", status)
    feats = F.count_if(F.col("train_kind").isNotNull() & (F.col("column_name") != target))
    miss = F.count_if(F.col("status") == "missing_in_test")
    crit = j.agg((miss > feats * 0.5).alias("critical"))
    return j.crossJoin(crit).select("column_name", "train_kind", "test_kind", "status", "critical")


def feature_kind_map(df: DataFrame, target: str | None = None) -> DataFrame:
    """V4: numeric / datetime / datetime-like / text-like / high-cardinality-object /
    categorical. The reference samples the first 50 non-null values to try a date
    parse; file order is not defined in Spark, so all non-null values are used."""
    fields = [f for f in df.schema.fields if f.name != target]
    direct = [(f.name, "numeric" if _is_numeric_like(f.dataType) else "datetime")
              for f in fields if _is_numeric_like(f.dataType)
              or isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    others = [f.name for f in fields if f.name not in dict(direct)]
    spark = df.sparkSession
    parts = [spark.createDataFrame(direct, "column_name string, kind string")] if direct else []
    if others:
        structs = []
        for c in others:
            s = F.col(c).cast("string")
            structs.append(F.struct(
                F.lit(c).alias("column_name"), F.count(s).alias("nn"),
                F.count(F.try_to_timestamp(s)).alias("n_dt"),
                F.avg(F.length(s)).alias("avg_len")))
        a = df.agg(F.array(*structs).alias("a")).select(F.explode("a").alias("s")).select("s.*")
        nd = distinct_counts(df, others)
        j = a.join(nd, "column_name", "left").fillna(0, ["n_distinct"])
        kind = (F.when(F.col("n_dt") == F.col("nn"), "datetime-like")
                .when(F.col("avg_len") > 50, "text-like")
                .when((F.col("n_distinct") > 0) & (F.col("n_distinct") / F.greatest(F.col("nn"), F.lit(1)) > 0.9),
                      "high-cardinality-object")
                .otherwise("categorical"))
        parts.append(j.select("column_name", kind.alias("kind")))
    return reduce(DataFrame.unionByName, parts)


def _id_name(c: str) -> bool:
    lc = c.lower()
    return any(lc == p or lc.endswith(p) for p in ID_NAME_PATTERNS)


def id_like_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    """V5: identifier-like by name, or distinct / rows > 0.95."""
    cols = [c for c in df.columns if c != target]
    nd = distinct_counts(df, cols)
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    names = df.sparkSession.createDataFrame([(c, _id_name(c)) for c in cols],
                                            "column_name string, by_name boolean")
    j = (F.broadcast(names).join(nd, "column_name", "left").crossJoin(n)
         .withColumn("u", F.coalesce(F.try_divide(F.col("n_distinct"), F.col("n_rows")), F.lit(0.0))))
    return (j.where(F.col("by_name") | (F.col("u") > 0.95))
             .select("column_name", F.lit("id_like_column").alias("risk"),
                     F.lit("medium").alias("severity"),
                     F.format_string("uniqueness=%.2f", F.col("u")).alias("detail")))


def missing_fractions(df: DataFrame, cols: list[str]) -> DataFrame:
    structs = [F.struct(F.lit(c).alias("column_name"),
                        F.avg(is_missing(df, c).cast("double")).alias("frac")) for c in cols]
    return df.agg(F.array(*structs).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def missingness_flags(df: DataFrame, target: str | None = None) -> DataFrame:
    """V6: missing fraction per column (> 0), with high / moderate flags and the
    100 %-missing drop candidates."""
    cols = [c for c in df.columns if c != target]
    m = missing_fractions(df, cols).where(F.col("frac") > 0)
    f = F.col("frac")
    risk = F.when(f >= MISS_HIGH, "high_missing_rate").when(f >= MISS_WARN, "moderate_missing_rate")
    sev = F.when(f >= MISS_HIGH, "high").when(f >= MISS_WARN, "medium")
    return m.select("column_name", r4(f).alias("missing_frac"), risk.alias("risk"),
                    sev.alias("severity"),
                    F.when(risk.isNotNull(), F.format_string("%.0f%% NaN", f * 100)).alias("detail"),
                    (f == 1.0).alias("drop_candidate"))


def constant_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    """V7: at most one distinct non-null value (``min <=> max``, one aggregate)."""
    cols = [c for c in df.columns if c != target]
    structs = [F.struct(F.lit(c).alias("column_name"),
                        F.min(clean(df, c)).eqNullSafe(F.max(clean(df, c))).alias("const"))
               for c in cols]
    a = df.agg(F.array(*structs).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    return (a.where("const").select("column_name", F.lit("constant_column").alias("risk"),
                                    F.lit("medium").alias("severity"),
                                    F.lit("0 or 1 unique value").alias("detail")))


def _numeric_features(df: DataFrame, target: str) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.name != target and _is_numeric_like(f.dataType)]


def _name_suspect(c: str) -> bool:
    return any(p in c.lower() for p in LEAKAGE_NAME_PATTERNS)


def leakage_by_name(df: DataFrame, target: str) -> DataFrame:
    """V8: numeric features whose name hints at the answer (schema only, no job)."""
    rows = [(c, "suspicious_name", "warning", None)
            for c in _numeric_features(df, target) if _name_suspect(c)]
    return df.sparkSession.createDataFrame(rows, FLAG_SCHEMA)


def leakage_by_correlation(df: DataFrame, target: str) -> DataFrame:
    """V9: |r| of median-imputed feature and target: > 0.98 high risk, > 0.90 warning.

    The numeric columns are written once, as the table may be a join that each pass would
    run again. Then medians (one row, a few passes), and one aggregate of correlations over
    the columns joined to that single broadcast row.
    """
    cols = [c for c in _numeric_features(df, target) if not _name_suspect(c)]
    if not cols:
        return _empty_flags(df.sparkSession)
    allc = cols + [target]
    src = stored(df.select(*[clean(df, c).cast("double").alias(c) for c in allc]), "leakage")
    from tablekit.operators.profile import median_row
    med = median_row(src, allc, "__m_")
    j = src.crossJoin(F.broadcast(med))
    y = F.coalesce(F.col(target), F.col("__m_" + target))
    structs = [F.struct(F.lit(c).alias("column_name"),
                        safe_corr(F.coalesce(F.col(c), F.col("__m_" + c)), y).alias("r"))
               for c in cols]
    a = (j.agg(F.array(*structs).alias("a")).select(F.explode("a").alias("s"))
          .select("s.column_name", F.abs("s.r").alias("r")))
    r = F.col("r")
    return (a.where(r > CORR_HIGH)
             .select("column_name",
                     F.when(r > CORR_CRITICAL, "near_perfect_correlation")
                      .otherwise("high_correlation").alias("risk"),
                     F.when(r > CORR_CRITICAL, "high_leakage_risk").otherwise("warning").alias("severity"),
                     F.format_string("corr=%.4f", r).alias("detail")))


def row_fingerprint(df: DataFrame, cols: list[str] | None = None) -> Column:
    """128-bit digest of a row's values, as two independent 64-bit hashes of the typed
    columns: time stamps to the microsecond, 0.0 equal to -0.0, NaN to NaN and NULL to NULL.
    The pattern of NULLs is hashed too, as the hash skips them. Grouping by it shuffles 16
    bytes per row instead of whole rows (long texts)."""
    cols = cols or df.columns
    nulls = F.concat(F.lit(""), *[F.col(c).isNull().cast("int").cast("string") for c in cols])
    return F.struct(F.xxhash64(nulls, *[F.col(c) for c in cols]).alias("a"),
                    F.xxhash64(F.lit(len(cols)), *[F.col(c) for c in reversed(cols)], nulls).alias("b"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows, NULLs equal; one grouped pass (partial
    aggregation collapses a hot duplicate inside each map task)."""
    g = df.select(row_fingerprint(df).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("c"))
    a = g.agg(F.sum(F.col("c") - 1).alias("dup"), F.sum("c").alias("n"))
    pct = F.col("dup") / F.col("n")
    return (a.where(F.col("dup") > 0)
             .select(F.lit("rows").alias("column_name"), F.lit("duplicate_rows").alias("risk"),
                     F.when(pct < 0.05, "medium").otherwise("high").alias("severity"),
                     F.format_string("%d duplicate rows (%.1f%%)", F.col("dup"), pct * 100).alias("detail"),
                     F.col("dup").cast("bigint").alias("n_duplicates")))


def drop_candidates(df: DataFrame, target: str | None = None) -> DataFrame:
    """Id-like ∪ 100 %-missing ∪ constant, one row per column, first reason kept."""
    ids = id_like_columns(df, target).select("column_name", F.lit(1).alias("o"),
                                             F.lit("id_like_column").alias("reason"))
    miss = (missingness_flags(df, target).where("drop_candidate")
            .select("column_name", F.lit(2).alias("o"), F.lit("all_missing").alias("reason")))
    const = constant_columns(df, target).select("column_name", F.lit(3).alias("o"),
                                                F.lit("constant_column").alias("reason"))
    u = ids.unionByName(miss).unionByName(const)
    return u.groupBy("column_name").agg(F.min_by("reason", "o").alias("reason"))


# The action that a finding recommends (%s: the column, or the rows to remove).
ACTIONS = {
    "high_skew_target": "consider log-transform for target",
    "id_like_column": "drop '%s' from modeling features (ID-like)",
    "all_missing": "drop '%s' (100%% NaN)",
    "constant_column": "drop constant column '%s'",
    "duplicate_rows": "deduplicate %s duplicate rows",
}


def validation_report(train: DataFrame, target: str, test: DataFrame | None = None) -> DataFrame:
    """The report's rows by section. ``summary``: rows of both tables, features; ``kinds``:
    each feature's kind; a section per rule with its findings; ``drop``: candidates to drop with
    the first reason; ``actions``: what the findings recommend; ``verdict``: ``can_proceed`` is
    false when any finding is critical. Columns: section, column_name, risk, severity, detail.

    The findings (a few rows per column) are written once; the verdict, the candidates and the
    actions are read from them, so no rule runs twice."""
    # every rule is an aggregate over the same table: compute (join) it once
    train = materialize(train)
    text = lambda c: F.lit(c).cast("string")
    v1 = target_checks(train, target)
    missing = materialize(missingness_flags(train, target))      # a row per column
    parts = [
        v1.select(F.lit("target").alias("section"), F.lit(target).alias("column_name"),
                  F.lit("target_check").alias("risk"),
                  F.when(F.col("can_proceed"), "ok").otherwise("critical").alias("severity"),
                  F.col("reason").alias("detail")),
        target_risk(train, target).withColumn("section", F.lit("target")),
        id_like_columns(train, target).withColumn("section", F.lit("id")),
        missing.where(F.col("risk").isNotNull())
        .select("column_name", "risk", "severity", "detail").withColumn("section", F.lit("missing")),
        constant_columns(train, target).withColumn("section", F.lit("constant")),
        leakage_by_name(train, target).withColumn("section", F.lit("leakage")),
        leakage_by_correlation(train, target).withColumn("section", F.lit("leakage")),
        duplicate_rows(train).drop("n_duplicates").withColumn("section", F.lit("duplicates")),
    ]
    if test is not None:
        sd = schema_diff(train, test, target)
        parts.append(sd.where(F.col("status").isin("missing_in_test", "unexpected_in_test",
                                                   "target_in_test"))
                     .select(F.lit("schema").alias("section"), "column_name",
                             F.col("status").alias("risk"),
                             F.when(F.col("critical"), "critical")
                              .when(F.col("status") == "unexpected_in_test", "low")
                              .otherwise("high").alias("severity"),
                             F.lit(None).cast("string").alias("detail")))
    cols = ["section", "column_name", "risk", "severity", "detail"]
    rules = materialize(reduce(DataFrame.unionByName, [p.select(*cols) for p in parts]))
    info = lambda section, name, risk, detail: [
        F.lit(section).alias("section"), name.alias("column_name"), risk.alias("risk"),
        F.lit("info").alias("severity"), detail.alias("detail")]
    count = F.count(F.lit(1)).cast("string")
    sizes = [("n_rows_train", train)] + ([("n_rows_test", test)] if test is not None else [])
    summary = [t.agg(count.alias("n")).select(*info("summary", text(None), F.lit(n), F.col("n"))) for n, t in sizes]
    summary.append(train.sparkSession.createDataFrame([(str(len(train.columns) - 1),)], "n string")
                   .select(*info("summary", text(None), F.lit("n_features"), F.col("n"))))
    kinds = feature_kind_map(train, target).select(*info("kinds", F.col("column_name"), F.col("kind"), text(None)))
    reasons = rules.where(F.col("risk").isin("id_like_column", "constant_column")).select(
        "column_name", "risk", F.when(F.col("risk") == "id_like_column", 1).otherwise(3).alias("o")).unionByName(
        missing.where("drop_candidate").select("column_name", F.lit("all_missing").alias("risk"), F.lit(2).alias("o")))
    drops = reasons.groupBy("column_name").agg(F.min_by("risk", "o").alias("r")).select(
        *info("drop", F.col("column_name"), F.col("r"), text(None)))
    found = reasons.select("column_name", "risk", F.col("column_name").alias("what")).unionByName(
        rules.where(F.col("risk").isin("high_skew_target", "duplicate_rows")).select(
            "column_name", "risk", F.regexp_extract("detail", r"^\d+", 0).alias("what")))
    advice = F.coalesce(*[F.when(F.col("risk") == r, F.format_string(t, "what") if "%s" in t else F.lit(t))
                          for r, t in ACTIONS.items()])
    actions = found.select(*info("actions", F.col("column_name"), F.col("risk"), advice))
    verdict = rules.agg(F.bool_and(F.col("severity") != "critical").alias("ok")).select(
        F.lit("verdict").alias("section"), F.lit(None).cast("string").alias("column_name"),
        F.lit("can_proceed").alias("risk"),
        F.when(F.col("ok"), "ok").otherwise("critical").alias("severity"),
        F.col("ok").cast("string").alias("detail"))
    return reduce(DataFrame.unionByName, [*summary, kinds, rules, drops, actions, verdict])


def mandatory_drops(df: DataFrame, target: str) -> DataFrame:
    """Drop candidates ∪ high-leakage columns ∪ columns missing >= 80 %."""
    a = drop_candidates(df, target).select("column_name")
    b = leakage_by_correlation(df, target).where(F.col("severity") == "high_leakage_risk") \
        .select("column_name")
    c = (missingness_flags(df, target).where(F.col("missing_frac") >= MISS_HIGH)
         .select("column_name"))
    return a.unionByName(b).unionByName(c).distinct()
