"""Event-log analytics (E1-E12, E14) over an event table
``(event_id, run_id, agent, event_type, timestamp, payload)``.

Payloads are JSON text whose shape depends on the event type; each type gets a
``from_json`` view with its own schema. Everything is grouped by ``run_id``
with partial aggregation; ``min_by``/``max_by`` replace "first"/"last" loops.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekit.functions.joins import running_min

# Payload schemas per event type (DDL strings).
PAYLOAD_SCHEMAS = {
    "model_result": ("model string, cv_mse_mean double, cv_mse_std double, cv_rmse_mean double, "
                     "log_transformed boolean, model_path string, drop_columns array<string>, "
                     "holdout_metrics struct<mse: double, rmse: double, mae: double, r2: double>"),
    "critique": "approved boolean, severity string, issues array<string>, suggestions array<string>",
    "plan": ("plan array<struct<id: string, agent: string, action: string, depends_on: array<string>>>, "
             "notes string"),
    "feature_decisions": ("decisions struct<drop_columns: array<string>, encode_columns: array<string>, "
                          "scale_columns: array<string>, log_transform_columns: array<string>, "
                          "interaction_features: array<string>, two_stage_recommended: boolean>"),
    "eda": "shape array<bigint>",
    "message": "text string",
    "validation_report": ("leakage_suspects array<struct<column: string, severity: string>>, "
                          "drop_candidates array<string>, target_stats struct<skewness: double>"),
}


def json_object_text(text: Column) -> Column:
    """E14 step 1: the substring from the first '{' to the last '}' ('' if none)."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def extract_json_object(responses: DataFrame, text_col: str, schema: str,
                        default: Column, out: str = "parsed") -> DataFrame:
    """Text response → typed record; unparseable → ``default`` (a struct
    literal of the same schema)."""
    parsed = F.from_json(json_object_text(F.col(text_col)), schema, {"mode": "PERMISSIVE"})
    return responses.withColumn(out, F.coalesce(parsed, default))


def critique_default(text: Column) -> Column:
    """Default critique when no JSON object is found: approved, minor, the
    whole response kept as the single suggestion."""
    return F.struct(F.lit(True).alias("approved"), F.lit("minor").alias("severity"),
                    F.array().cast("array<string>").alias("issues"),
                    F.array(text).alias("suggestions"))


def typed_events(events: DataFrame, event_type: str) -> DataFrame:
    """Events of one type with the payload parsed by that type's schema."""
    schema = PAYLOAD_SCHEMAS[event_type]
    ev = events.where(F.col("event_type") == event_type)
    parsed = F.from_json(json_object_text(F.col("payload")), schema)
    return ev.select("event_id", "run_id", "agent", "event_type", "timestamp",
                     parsed.alias("p")).select("*", "p.*").drop("p")


def best_models(events: DataFrame, n: int = 3) -> DataFrame:
    """Top-n model results over all runs by lowest CV MSE (NULLs skipped)."""
    mr = typed_events(events, "model_result").where(F.col("cv_mse_mean").isNotNull())
    top = mr.orderBy("cv_mse_mean", "event_id").limit(n)
    w = Window.orderBy("cv_mse_mean", "event_id")   # on the n rows only
    return top.select(F.row_number().over(w).cast("bigint").alias("rank"), "run_id", "event_id",
                      "model", "cv_mse_mean", "cv_rmse_mean")


def latest_event(events: DataFrame, event_type: str, key: str = "run_id") -> DataFrame:
    """The latest event of a type per key (by timestamp, then event_id)."""
    ev = events.where(F.col("event_type") == event_type)
    last = F.max_by(F.struct("event_id", "timestamp", "payload"), F.struct("timestamp", "event_id"))
    return ev.groupBy(key).agg(last.alias("l")).select(key, "l.*")


def run_summary(events: DataFrame) -> DataFrame:
    """Per run — events, model results, critiques, best model and its MSE."""
    mse = F.get_json_object(json_object_text(F.col("payload")), "$.cv_mse_mean").cast("double")
    model = F.get_json_object(json_object_text(F.col("payload")), "$.model")
    is_mr = F.col("event_type") == "model_result"
    x = events.select("run_id", "event_type", "timestamp", "event_id",
                      F.when(is_mr, mse).alias("mse"), F.when(is_mr, model).alias("model"))
    order = F.struct("mse", "timestamp", "event_id")
    return x.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_events"),
        F.count_if(F.col("event_type") == "model_result").cast("bigint").alias("model_experiments"),
        F.count_if(F.col("event_type") == "critique").cast("bigint").alias("critiques_issued"),
        F.min_by(F.when(F.col("mse").isNotNull(), F.col("model")),
                 F.when(F.col("mse").isNotNull(), order)).alias("best_model"),
        F.min("mse").alias("best_cv_mse"))


run_index = run_summary


def past_results_text(events: DataFrame, n: int = 3) -> DataFrame:
    """The top results as one text block."""
    b = best_models(events, n)
    line = F.format_string("- %s | CV MSE=%s | RMSE=%s | run=%s", F.col("model"),
                           F.col("cv_mse_mean").cast("string"),
                           F.coalesce(F.col("cv_rmse_mean").cast("string"), F.lit("?")), F.col("run_id"))
    agg = b.agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("ls"))
    return agg.select(F.when(F.size("ls") > 0, F.concat(
        F.lit("Past experiment results (best models by CV MSE):\n"),
        F.array_join(F.transform("ls", lambda s: s["l"]), "\n"))).otherwise(F.lit("")).alias("text"))


def _py_list(arr: Column) -> Column:
    """Render an array of strings like a Python list: ['a', 'b']."""
    return F.concat(F.lit("["), F.array_join(F.transform(arr, lambda x: F.concat(F.lit("'"), x, F.lit("'"))),
                                             ", "), F.lit("]"))


# Tags attached to exported experiment chunks.
MODEL_TAGS = ["experiment", "model_selection", "regression", "evaluation"]
FEATURE_TAGS = ["experiment", "feature_engineering", "regression"]
VALIDATION_TAGS = ["experiment", "validation", "leakage", "regression"]


def results_to_chunks(events: DataFrame) -> DataFrame:
    """Model results, feature decisions and validation findings as chunks
    ``(text, source, tags)``."""
    src = F.concat(F.lit("experiment:"), F.col("run_id"))
    mr = typed_events(events, "model_result").where(F.col("cv_mse_mean").isNotNull())
    r2 = F.col("holdout_metrics.r2")
    drop = F.col("drop_columns")
    mtext = F.concat(
        F.lit("Experiment "), F.col("run_id"), F.lit(": model="), F.coalesce(F.col("model"), F.lit("unknown")),
        F.lit(" achieved CV MSE="), F.format_string("%.4f", F.col("cv_mse_mean")),
        F.lit(", CV RMSE="), F.format_string("%.4f", F.col("cv_rmse_mean")),
        F.when(r2.isNotNull(), F.format_string(", holdout R²=%.4f", r2)).otherwise(F.lit("")),
        F.when(F.size(F.coalesce(drop, F.array())) > 0,
               F.concat(F.lit(". Dropped columns: "), _py_list(drop), F.lit("."))).otherwise(F.lit(".")))
    m = mr.select(mtext.alias("text"), src.alias("source"),
                  F.array(*[F.lit(t) for t in MODEL_TAGS]).alias("tags"))

    fd = typed_events(events, "feature_decisions").select("run_id", "decisions.*")

    def part(c, label):
        return F.when(F.size(F.coalesce(F.col(c), F.array())) > 0,
                      F.concat(F.lit(label), _py_list(F.col(c))))
    parts = F.array_compact(F.array(part("drop_columns", "dropped: "),
                                    part("log_transform_columns", "log-transformed: "),
                                    part("encode_columns", "encoded: "),
                                    part("scale_columns", "scaled: ")))
    f = (fd.select("run_id", parts.alias("parts")).where(F.size("parts") > 0)
           .select(F.concat(F.lit("Experiment "), F.col("run_id"), F.lit(" feature engineering: "),
                            F.array_join("parts", "; "), F.lit(".")).alias("text"),
                   src.alias("source"), F.array(*[F.lit(t) for t in FEATURE_TAGS]).alias("tags")))

    vr = typed_events(events, "validation_report")
    suspects = F.transform(F.filter("leakage_suspects", lambda s: s["severity"] == "high_leakage_risk"),
                           lambda s: s["column"])
    skew = F.col("target_stats.skewness")
    vparts = F.array_compact(F.array(
        F.when(F.size(F.coalesce(suspects, F.array())) > 0,
               F.concat(F.lit("high-leakage columns: "), _py_list(suspects))),
        F.when(F.size(F.coalesce(F.col("drop_candidates"), F.array())) > 0,
               F.concat(F.lit("ID/constant/empty drop candidates: "), _py_list(F.col("drop_candidates")))),
        F.when(F.abs(skew) > 1, F.format_string("target skewness=%.2f — consider log-transform", skew))))
    v = (vr.select("run_id", vparts.alias("parts")).where(F.size("parts") > 0)
           .select(F.concat(F.lit("Experiment "), F.col("run_id"), F.lit(" validation findings: "),
                            F.array_join("parts", "; "), F.lit(".")).alias("text"),
                   src.alias("source"), F.array(*[F.lit(t) for t in VALIDATION_TAGS]).alias("tags")))
    return reduce(DataFrame.unionByName, [m, f, v])


def agent_participation(events: DataFrame) -> DataFrame:
    """Events per (run, agent)."""
    return events.groupBy("run_id", "agent").agg(F.count(F.lit(1)).cast("bigint").alias("n_events"))


def critique_convergence(events: DataFrame) -> DataFrame:
    """Approved ÷ critiques (2 decimals) counting every approved critique,
    as the reference does, plus whether the run's first critique approved."""
    c = typed_events(events, "critique")
    return c.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_critiques"),
        F.count_if(F.col("approved") == F.lit(True)).cast("bigint").alias("approvals"),
        F.round(F.count_if(F.col("approved") == F.lit(True)) / F.count(F.lit(1)), 2).alias("convergence_rate"),
        F.coalesce(F.min_by("approved", F.struct("timestamp", "event_id")), F.lit(False))
         .alias("first_pass_approved"))


def metric_trajectory(events: DataFrame) -> DataFrame:
    """Per run the MSE values in time order: count, best, first, last,
    first − last (2 decimals, needs two values) and the running best at the end."""
    mr = typed_events(events, "model_result").where(F.col("cv_mse_mean").isNotNull())
    o = F.struct("timestamp", "event_id")
    g = mr.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_results"),
        F.min("cv_mse_mean").alias("best_cv_mse"),
        F.min_by("cv_mse_mean", o).alias("first_mse"),
        F.max_by("cv_mse_mean", o).alias("last_mse"))
    return g.withColumn("mse_improvement", F.when(
        F.col("n_results") >= 2, F.round(F.col("first_mse") - F.col("last_mse"), 2)))


def running_best(events: DataFrame) -> DataFrame:
    """E10 (series form): per model result the best MSE so far in its run. A run is spread
    over partitions by time (``running_min``), so a busy one is in no single task."""
    mr = typed_events(events, "model_result").where(F.col("cv_mse_mean").isNotNull())
    series = mr.select("run_id", "event_id", "timestamp", "cv_mse_mean")
    return running_min(series, ["run_id"], ["timestamp", "event_id"], "cv_mse_mean", "best_so_far").drop("timestamp")


def plan_adherence(events: DataFrame) -> DataFrame:
    """Steps in the run's first plan, distinct non-system agents."""
    plans = typed_events(events, "plan")
    first = plans.groupBy("run_id").agg(
        F.min_by(F.size(F.coalesce("plan", F.array())), F.struct("timestamp", "event_id"))
        .cast("bigint").alias("planned_steps"))
    agents = (events.where(F.col("agent") != "system").groupBy("run_id")
              .agg(F.count_distinct("agent").cast("bigint").alias("unique_agents_used")))
    runs = events.select("run_id").distinct()
    return (runs.join(first, "run_id", "left").join(agents, "run_id", "left")
                .fillna(0, ["planned_steps", "unique_agents_used"]))


def agent_benchmark(events: DataFrame) -> DataFrame:
    """One report row per run (E8-E11) from one scan: counts per (run, agent) first,
    so that partial aggregation carries a busy run, then per run."""
    def of(event_type, field):
        parsed = F.from_json(json_object_text(F.col("payload")), PAYLOAD_SCHEMAS[event_type])
        return F.when(F.col("event_type") == event_type, parsed[field])
    x = events.select("run_id", "agent", "event_type", F.struct("timestamp", "event_id").alias("o"),
                      of("critique", "approved").alias("approved"), of("model_result", "cv_mse_mean").alias("mse"),
                      F.when(F.col("event_type") == "plan", F.size(F.coalesce(of("plan", "plan"), F.array()))).alias("steps"))
    timed = lambda c: F.when(F.col(c).isNotNull(), F.struct("o", F.col(c).alias("v")))
    big = lambda c: c.cast("bigint")
    by_agent = x.groupBy("run_id", "agent").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "critique").alias("critiques"),
        F.count_if(F.col("approved") == F.lit(True)).alias("approvals"),
        F.count_if(F.col("event_type") == "model_result").alias("results"), F.count("mse").alias("measured"),
        F.min("mse").alias("best"), F.min(timed("mse")).alias("first"), F.max(timed("mse")).alias("last"),
        F.min(timed("steps")).alias("plan"))
    runs = by_agent.groupBy("run_id").agg(
        big(F.sum("n")).alias("total_events"), big(F.count(F.lit(1))).alias("n_agents"),
        big(F.sum("critiques")).alias("critiques"), big(F.sum("approvals")).alias("approvals"),
        big(F.sum("results")).alias("results"), F.sum("measured").alias("measured"),
        F.min("best").alias("best_cv_mse"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.min("plan").alias("plan"), big(F.count_if(F.col("agent") != "system")).alias("unique_agents_used"))
    return runs.select(
        "run_id", "total_events", "n_agents", F.col("critiques").alias("total_critiques"),
        F.col("approvals").alias("first_pass_approvals"),
        F.when(F.col("critiques") > 0, F.round(F.col("approvals") / F.col("critiques"), 2)).alias("convergence_rate"),
        F.col("results").alias("experiments_run"), "best_cv_mse",
        F.when(F.col("measured") >= 2, F.round(F.col("first.v") - F.col("last.v"), 2)).alias("mse_improvement"),
        F.coalesce(F.col("plan.v"), F.lit(0)).cast("bigint").alias("planned_steps"), "unique_agents_used")


def parse_critiques(events: DataFrame) -> DataFrame:
    """E14 on the critique responses: typed record or the default."""
    c = events.where(F.col("event_type") == "critique")
    out = extract_json_object(c, "payload", PAYLOAD_SCHEMAS["critique"],
                              critique_default(F.col("payload")), "critique")
    return out.select("event_id", "run_id", F.col("critique.approved").alias("approved"),
                      F.col("critique.severity").alias("severity"),
                      F.when(F.col("critique.suggestions").isNull(), F.lit(0))
                       .otherwise(F.size("critique.suggestions")).cast("bigint").alias("n_suggestions"))
