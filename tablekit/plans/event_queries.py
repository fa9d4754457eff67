"""Registered event-log queries (E1-E12, E14) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekit.operators import events as E
from tablekit.plans import views as V
from tablekit.plans.views import duck_with
from tablekit.session import table


def _typed_mr(s, d):
    t = E.typed_events(V.event_log(s, d), "model_result")
    return t.select("event_id", "run_id", "agent", "model", "cv_mse_mean", "cv_rmse_mean")


def _chunks(s, d):
    c = E.results_to_chunks(V.event_log(s, d))
    return c.select("text", "source", F.array_join("tags", ",").alias("tags"))


def _parse_conversations(s, d):
    c = table(s, d, "conversations")
    out = E.extract_json_object(c, "text", E.PAYLOAD_SCHEMAS["critique"],
                                E.critique_default(F.col("text")), "critique")
    return out.select("conv_id", "turn", F.col("critique.approved").alias("approved"),
                      F.col("critique.severity").alias("severity"),
                      F.size("critique.suggestions").cast("bigint").alias("n_suggestions"))


QUERIES = {
    "typed_events": _typed_mr,
    "best_models": lambda s, d: E.best_models(V.event_log(s, d), 3),
    "latest_event": lambda s, d: E.latest_event(V.event_log(s, d), "eda"),
    "run_summary": lambda s, d: E.run_summary(V.event_log(s, d)),
    "run_index": lambda s, d: E.run_index(V.event_log(s, d)),
    "past_results_text": lambda s, d: E.past_results_text(V.event_log(s, d), 3),
    "results_to_chunks": _chunks,
    "agent_participation": lambda s, d: E.agent_participation(V.event_log(s, d)),
    "critique_convergence": lambda s, d: E.critique_convergence(V.event_log(s, d)),
    "metric_trajectory": lambda s, d: E.metric_trajectory(V.event_log(s, d)),
    "running_best": lambda s, d: E.running_best(V.event_log(s, d)),
    "plan_adherence": lambda s, d: E.plan_adherence(V.event_log(s, d)),
    "agent_benchmark": lambda s, d: E.agent_benchmark(V.event_log(s, d)),
    "extract_json_object": lambda s, d: E.parse_critiques(V.event_log(s, d)),
    "extract_json_default": _parse_conversations,
}

_OBJ = r"regexp_extract(payload, '(?s)\{.*\}', 0)"

_EV = duck_with("event_log").rstrip() + f""",
  ev as (select *, {_OBJ} as obj from event_log),
  mr as (select event_id, run_id, agent, "timestamp", json_extract_string(obj, '$.model') as model,
                try_cast(json_extract_string(obj, '$.cv_mse_mean') as double) as cv_mse_mean,
                try_cast(json_extract_string(obj, '$.cv_rmse_mean') as double) as cv_rmse_mean
         from ev where event_type = 'model_result'),
  cr as (select event_id, run_id, "timestamp", try_cast(json_extract_string(obj, '$.approved') as boolean)
                as approved from ev where event_type = 'critique'),
  best as (select row_number() over (order by cv_mse_mean, event_id) as rank, run_id, event_id, model,
                  cv_mse_mean, cv_rmse_mean
           from mr where cv_mse_mean is not null order by cv_mse_mean, event_id limit 3),
  summary as (select run_id, count(*) as total_events,
                count_if(event_type = 'model_result') as model_experiments,
                count_if(event_type = 'critique') as critiques_issued,
                first(model order by mse, "timestamp", event_id) filter (where mse is not null) as best_model,
                min(mse) as best_cv_mse
              from (select *, case when event_type = 'model_result' then
                             try_cast(json_extract_string(obj, '$.cv_mse_mean') as double) end as mse,
                           case when event_type = 'model_result' then json_extract_string(obj, '$.model') end
                             as model from ev) x group by run_id),
  conv as (select run_id, count(*) as total_critiques, count_if(approved) as approvals,
             round(count_if(approved) / count(*), 2) as convergence_rate,
             coalesce(first(approved order by "timestamp", event_id), false) as first_pass_approved
           from cr group by run_id),
  traj as (select run_id, count(*) as n_results, min(cv_mse_mean) as best_cv_mse,
             first(cv_mse_mean order by "timestamp", event_id) as first_mse,
             first(cv_mse_mean order by "timestamp" desc, event_id desc) as last_mse,
             case when count(*) >= 2 then round(first(cv_mse_mean order by "timestamp", event_id)
                  - first(cv_mse_mean order by "timestamp" desc, event_id desc), 2) end as mse_improvement
           from mr where cv_mse_mean is not null group by run_id),
  plans as (select run_id, first(coalesce(json_array_length(json_extract(obj, '$.plan')), 0)
                                 order by "timestamp", event_id) as planned_steps
            from ev where event_type = 'plan' group by run_id),
  agents as (select run_id, count(distinct agent) as unique_agents_used from ev
             where agent <> 'system' group by run_id),
  adherence as (select r.run_id, coalesce(planned_steps, 0) as planned_steps,
                  coalesce(unique_agents_used, 0) as unique_agents_used
                from (select distinct run_id from ev) r left join plans using (run_id)
                left join agents using (run_id)),
  part as (select run_id, agent, count(*) as n_events from ev group by all)
"""

_PYLIST = "'[' || array_to_string(list_transform({l}, lambda x: '''' || x || ''''), ', ') || ']'"

ORACLE = {
    "typed_events": _EV + "select event_id, run_id, agent, model, cv_mse_mean, cv_rmse_mean from mr",
    "best_models": _EV + "select * from best",
    "latest_event": _EV + """select run_id, event_id, "timestamp", payload from ev where event_type = 'eda'
      qualify row_number() over (partition by run_id order by "timestamp" desc, event_id desc) = 1""",
    "run_summary": _EV + "select * from summary",
    "run_index": _EV + "select * from summary",
    "past_results_text": _EV + """select case when count(*) > 0 then
        'Past experiment results (best models by CV MSE):' || chr(10) ||
        string_agg('- ' || model || ' | CV MSE=' || cast(cv_mse_mean as varchar) || ' | RMSE='
                   || coalesce(cast(cv_rmse_mean as varchar), '?') || ' | run=' || run_id, chr(10) order by rank)
        else '' end as text from best""",
    "results_to_chunks": _EV + f"""
      select 'Experiment ' || run_id || ': model=' || coalesce(model, 'unknown') || ' achieved CV MSE='
             || printf('%.4f', cv_mse_mean) || ', CV RMSE=' || printf('%.4f', cv_rmse_mean) || '.' as text,
             'experiment:' || run_id as source, 'experiment,model_selection,regression,evaluation' as tags
      from mr where cv_mse_mean is not null
      union all
      select 'Experiment ' || run_id || ' feature engineering: dropped: '
             || {_PYLIST.format(l="dc")} || '.', 'experiment:' || run_id,
             'experiment,feature_engineering,regression'
      from (select run_id, cast(json_extract(obj, '$.decisions.drop_columns') as varchar[]) as dc
            from ev where event_type = 'feature_decisions') f where len(dc) > 0""",
    "agent_participation": _EV + "select * from part",
    "critique_convergence": _EV + "select * from conv",
    "metric_trajectory": _EV + "select * from traj",
    "running_best": _EV + """select run_id, event_id, cv_mse_mean,
      min(cv_mse_mean) over (partition by run_id order by "timestamp", event_id
                             rows between unbounded preceding and current row) as best_so_far
      from mr where cv_mse_mean is not null""",
    "plan_adherence": _EV + "select * from adherence",
    "agent_benchmark": _EV + """select p.run_id, p.total_events, p.n_agents,
        coalesce(total_critiques, 0) as total_critiques, coalesce(approvals, 0) as first_pass_approvals,
        convergence_rate, coalesce(experiments_run, 0) as experiments_run, best_cv_mse, mse_improvement,
        planned_steps, unique_agents_used
      from (select run_id, cast(sum(n_events) as bigint) as total_events, count(*) as n_agents
            from part group by run_id) p
      left join conv using (run_id)
      left join (select run_id, count(*) as experiments_run from ev where event_type = 'model_result'
                 group by run_id) e using (run_id)
      left join traj using (run_id) left join adherence using (run_id)""",
    "extract_json_object": _EV + """select event_id, run_id,
        coalesce(try_cast(json_extract_string(obj, '$.approved') as boolean), true) as approved,
        coalesce(json_extract_string(obj, '$.severity'), 'minor') as severity,
        cast(coalesce(json_array_length(json_extract(obj, '$.suggestions')), 0) as bigint) as n_suggestions
      from ev where event_type = 'critique'""",
    "extract_json_default": r"""select conv_id, turn, true as approved, 'minor' as severity,
        cast(1 as bigint) as n_suggestions from conversations
      where regexp_extract(text, '(?s)\{.*\}', 0) = ''""",
}
