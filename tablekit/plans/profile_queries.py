"""Registered profiling queries (A1-A15) and their DuckDB twins."""

from __future__ import annotations

from tablekit.operators import profile as P
from tablekit.plans import sqlgen as S
from tablekit.plans import views as V
from tablekit.plans.views import duck_with
from tablekit.session import table

# column lists of the driver tables / views (schema facts, used by the SQL twins)
LINEITEM_NUM = [("l_orderkey", False), ("l_partkey", False), ("l_suppkey", False),
                ("l_linenumber", False), ("l_quantity", True), ("l_extendedprice", True),
                ("l_discount", True), ("l_tax", True)]
HOLES_NUM = LINEITEM_NUM + [("q_null", True), ("d_null", True), ("t_null", True),
                            ("all_null", True), ("const_col", False), ("rare", True)]
HOLES_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
             "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
             "l_shipdate", "q_null", "d_null", "t_null", "s_null", "all_null", "const_col",
             "flag", "rare"]
HOLES_FLOAT = {c for c, f in HOLES_NUM if f}
TRAIN_NUM = [("target", True), ("leaky", True), ("l_quantity", True), ("l_discount", True),
             ("l_tax", True), ("p_size", False), ("p_retailprice", True)]
EVENTS_NUM = [("event_id", False), ("user_id", False), ("value", True)]


def _num_profile_sql(src: str, cols) -> str:
    parts = []
    for c, fl in cols:
        x = f"cast({S.clean(c, fl)} as double)"
        parts.append(f"""select '{c}' as column_name, round(avg(x),4) as mean,
          round(stddev_samp(x),4) as std, round(min(x),4) as min,
          round(quantile_cont(x,0.25),4) as p25, round(quantile_cont(x,0.5),4) as p50,
          round(quantile_cont(x,0.75),4) as p75, round(max(x),4) as max,
          round({S.skew('x')},4) as skew, round({S.kurt('x')},4) as kurtosis
          from (select {x} as x from {src}) t""")
    return S.union_all(parts)


def _cat_profile_sql(src: str, cols: list[str]) -> str:
    unp = S.union_all([f"select '{c}' as column_name, cast({S.q(c)} as varchar) as value from {src} "
                       f"where {S.q(c)} is not null" for c in cols])
    return f"""with u as ({unp}),
      vc as (select column_name, value, count(*) as cnt from u group by 1, 2),
      nd as (select column_name, count(*) as n_distinct from vc group by 1),
      rk as (select *, row_number() over (partition by column_name order by cnt desc, value) as rank from vc)
      select rk.column_name, nd.n_distinct, cast(rank as bigint) as rank, value, cast(cnt as bigint) as cnt
      from rk join nd using (column_name) where rank <= 5"""


def _missing_sql(src: str, cols: list[str], floats: set[str]) -> str:
    def miss(c):
        return f"({S.q(c)} is null or isnan({S.q(c)}))" if c in floats else f"{S.q(c)} is null"
    parts = [f"select '{c}' as column_name, cast(count_if({miss(c)}) as bigint) as missing_count, "
             f"count(*) as total_rows from {src}" for c in cols]
    return f"""select column_name, missing_count,
      round(missing_count / total_rows * 100, 2) as missing_pct, cast(total_rows as bigint) as total_rows
      from ({S.union_all(parts)}) m where missing_count > 0"""


def _outlier_sql(src: str, cols) -> str:
    parts = []
    for c, fl in cols:
        x = f"cast({S.clean(c, fl)} as double)"
        parts.append(f"""select '{c}' as column_name, count_if(x < lo or x > hi) as outlier_count,
          count(*) as n, any_value(lo) as lo, any_value(hi) as hi
          from (select {x} as x from {src}) t,
               (select quantile_cont({x},0.25) - 1.5*(quantile_cont({x},0.75)-quantile_cont({x},0.25)) as lo,
                       quantile_cont({x},0.75) + 1.5*(quantile_cont({x},0.75)-quantile_cont({x},0.25)) as hi
                from {src}) f""")
    return f"""select column_name, cast(outlier_count as bigint) as outlier_count,
      round(outlier_count / n * 100, 2) as outlier_pct, round(lo,4) as lower_fence,
      round(hi,4) as upper_fence from ({S.union_all(parts)}) o where outlier_count > 0"""


def _distinct_sql(src: str, cols: list[str]) -> str:
    return S.union_all([f"select '{c}' as column_name, cast(count(distinct {S.q(c)}) as bigint) "
                        f"as n_distinct from {src}" for c in cols])


PART_KINDS = [("p_partkey", "number"), ("p_name", "string"), ("p_brand", "string"),
              ("p_type", "string"), ("p_size", "number"), ("p_retailprice", "number")]


def _encoding_sql() -> str:
    nd = _distinct_sql("part", [c for c, _ in PART_KINDS])
    kinds = ", ".join(f"('{c}','{k}')" for c, k in PART_KINDS)
    return f"""select k.column_name, d.n_distinct,
      case when kind = 'string' then (case when n_distinct <= 20 then 'one_hot_encode' else 'label_encode_or_drop' end)
           else (case when n_distinct <= 10 then 'treat_as_categorical_or_keep' else 'scale_numeric' end) end
           as recommendation
      from (values {kinds}) k(column_name, kind) join ({nd}) d using (column_name)"""


def _corr_sql(src: str, target: str, cols) -> str:
    parts = [f"select '{c}' as column_name, {S.corr(f'cast({S.q(c)} as double)', target)} as r from {src}"
             for c, _ in cols if c != target]
    return S.union_all(parts)


def _feature_summary(s, d):
    from tablekit.operators import features as FE
    df = FE.prepare_table(V.train_view(s, d), None, ["leaky"], indicator_cols=[])
    return P.feature_summary(df, "target")


QUERIES = {
    "class_balance": lambda s, d: P.class_balance(table(s, d, "events"), "value"),
    "full_profile": lambda s, d: P.full_profile(V.train_view(s, d), "target"),
    "feature_summary": _feature_summary,
    "numeric_profile": lambda s, d: P.numeric_profile(table(s, d, "lineitem")),
    "numeric_profile_holes": lambda s, d: P.numeric_profile(
        V.holes(s, d), [c for c, _ in HOLES_NUM]),
    "categorical_profile": lambda s, d: P.categorical_profile(table(s, d, "orders")),
    "categorical_profile_part": lambda s, d: P.categorical_profile(table(s, d, "part")),
    "missing_report": lambda s, d: P.missing_report(V.holes(s, d)),
    "complete_row_count": lambda s, d: P.complete_row_count(V.holes(s, d).drop("all_null")),
    "target_distribution": lambda s, d: P.target_distribution(table(s, d, "events"), "value"),
    "target_correlation": lambda s, d: P.target_correlation(V.train_view(s, d), "target"),
    "factorize_target": lambda s, d: P.factorize_target(
        table(s, d, "orders"), "o_orderpriority", "o_orderkey"),
    "multicollinear_pairs": lambda s, d: P.multicollinear_pairs(V.train_view(s, d), None),
    "iqr_outliers": lambda s, d: P.iqr_outliers(table(s, d, "lineitem")),
    "iqr_outliers_events": lambda s, d: P.iqr_outliers(table(s, d, "events")),
    "encoding_recommendation": lambda s, d: P.encoding_recommendation(table(s, d, "part")),
    "zero_inflation": lambda s, d: P.zero_inflation(V.zero_view(s, d), "target"),
    "log_target_rule": lambda s, d: P.log_target_rule(V.zero_view(s, d), "target"),
    "high_cardinality": lambda s, d: P.high_cardinality(table(s, d, "orders")),
}

_ORDERS_CAT = ["o_orderstatus", "o_orderdate", "o_orderpriority"]
_PART_CAT = ["p_name", "p_brand", "p_type"]

_FS_NUM = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice", "days_since_last_review",
           "last_review_year", "last_review_month", "last_review_dow", "last_review_quarter",
           "last_review_is_weekend", "last_review_month_sin", "last_review_month_cos",
           "last_review_dow_sin", "last_review_dow_cos"]
_FS_CAT = ["row_key", "p_brand", "p_type", "o_orderpriority", "o_orderstatus"]

_TD_SQL = """select 'value' as target_column, round(avg(value),4) as mean,
      round(quantile_cont(value,0.5),4) as median, round(stddev_samp(value),4) as std,
      min(value) as min, max(value) as max, round(""" + S.skew("value") + """,4) as skew,
      round(count_if(value = 0) / count(*) * 100, 2) as pct_zero,
      round(quantile_cont(value,0.25),2) as p25, round(quantile_cont(value,0.5),2) as p50,
      round(quantile_cont(value,0.75),2) as p75, round(quantile_cont(value,0.9),2) as p90,
      round(quantile_cont(value,0.95),2) as p95 from events"""

ORACLE = {
    "feature_summary": duck_with("train_view") + f"""select count(*) as n_samples,
      cast({len(_FS_NUM) + len(_FS_CAT)} as bigint) as n_features,
      '{",".join(_FS_NUM)}' as numeric_columns, '{",".join(_FS_CAT)}' as categorical_columns,
      round(avg(case when target = 0 then 1.0 else 0.0 end), 4) as pct_zero,
      round(avg(case when target = 0 then 1.0 else 0.0 end), 4) > 0.15 as two_stage_recommended,
      round({S.skew('target')}, 4) as skew,
      round({S.skew('target')}, 4) > 1 and min(target) >= 0 as log_transform,
      (select string_agg(c, ',' order by c) from (
         select 'row_key' as c where (select count(distinct row_key) from train_view) > 10
         union all select 'p_brand' where (select count(distinct p_brand) from train_view) > 10
         union all select 'p_type' where (select count(distinct p_type) from train_view) > 10
         union all select 'o_orderpriority' where (select count(distinct o_orderpriority) from train_view) > 10
         union all select 'o_orderstatus' where (select count(distinct o_orderstatus) from train_view) > 10) h)
        as high_cardinality
      from train_view""",
    "numeric_profile": _num_profile_sql("lineitem", LINEITEM_NUM),
    "numeric_profile_holes": duck_with("holes") + _num_profile_sql("holes", HOLES_NUM),
    "categorical_profile": _cat_profile_sql("orders", _ORDERS_CAT),
    "categorical_profile_part": _cat_profile_sql("part", _PART_CAT),
    "missing_report": duck_with("holes") + _missing_sql("holes", HOLES_ALL, HOLES_FLOAT),
    "complete_row_count": duck_with("holes") + """select cast(count(*) as bigint) as total_rows,
      cast(count_if(l_orderkey is not null and q_null is not null and d_null is not null
        and t_null is not null and s_null is not null and rare is not null
        and not isnan(q_null) and not isnan(d_null) and not isnan(t_null)) as bigint) as complete_rows
      from holes""",
    "target_distribution": _TD_SQL,
    "class_balance": _TD_SQL,
    "target_correlation": duck_with("train_view") + f"""select column_name, round(r,4) as corr,
      cast(rank as bigint) as rank from (
        select *, row_number() over (order by abs(r) desc, column_name) as rank
        from ({_corr_sql('train_view', 'target', TRAIN_NUM)}) c where r is not null) x
      where rank <= 10""",
    "factorize_target": """select value, cast(row_number() over (order by first_seen, value) - 1 as bigint) as code
      from (select cast(o_orderpriority as varchar) as value, min(o_orderkey) as first_seen
            from orders where o_orderpriority is not null group by 1) f""",
    "multicollinear_pairs": duck_with("train_view") + "select col1, col2, round(r,4) as corr from (" +
        S.union_all([f"select '{a}' as col1, '{b}' as col2, abs({S.corr(S.q(a), S.q(b))}) as r "
                     f"from train_view"
                     for i, (a, _) in enumerate(TRAIN_NUM) for b, _ in TRAIN_NUM[i + 1:]]) +
        ") p where r > 0.9",
    "iqr_outliers": _outlier_sql("lineitem", LINEITEM_NUM),
    "iqr_outliers_events": _outlier_sql("events", EVENTS_NUM),
    "encoding_recommendation": _encoding_sql(),
    "zero_inflation": duck_with("zero_view") + """select round(avg(case when target = 0 then 1.0 else 0.0 end),4)
      as pct_zero, avg(case when target = 0 then 1.0 else 0.0 end) > 0.15 as two_stage_recommended
      from zero_view""",
    "log_target_rule": duck_with("zero_view") + f"""select round({S.skew('target')},4) as skew,
      min(target) as min, ({S.skew('target')} > 1 and min(target) >= 0) as apply_log from zero_view""",
    "high_cardinality": "select * from (" + _distinct_sql("orders", _ORDERS_CAT) +
        ") d where n_distinct > 10",
}


def _full_profile_sql() -> str:
    """Twin of ``full_profile(train_view, 'target')``: the section tables unioned."""
    src = "train_view"
    num = TRAIN_NUM + []
    cat = ["row_key", "p_brand", "p_type", "o_orderpriority", "o_orderstatus", "last_dt", "name"]
    stats = ["mean", "std", "min", "p25", "p50", "p75", "max", "skew", "kurtosis"]
    numeric = S.union_all([f"select 'numeric' as section, column_name, '{st}' as stat, {st} as value, "
                           f"cast(null as varchar) as label from np" for st in stats])
    tstats = [("mean", "round(avg(target),4)"), ("median", "round(quantile_cont(target,0.5),4)"),
              ("std", "round(stddev_samp(target),4)"), ("min", "min(target)"), ("max", "max(target)"),
              ("skew", f"round({S.skew('target')},4)"),
              ("pct_zero", "round(count_if(target = 0) / count(*) * 100, 2)"),
              *[(f"p{p}", f"round(quantile_cont(target, {p / 100}), 2)") for p in (25, 50, 75, 90, 95)]]
    target = S.union_all([f"select 'target', 'target', '{n}', cast({e} as double), cast(null as varchar) "
                          f"from {src}" for n, e in tstats])
    enc_kinds = [("row_key", "string"), ("leaky", "number"), ("l_quantity", "number"),
                 ("l_discount", "number"), ("l_tax", "number"), ("p_size", "number"),
                 ("p_retailprice", "number"), ("p_brand", "string"), ("p_type", "string"),
                 ("o_orderpriority", "string"), ("o_orderstatus", "string"), ("name", "string")]
    nd = _distinct_sql(src, [c for c, _ in enc_kinds])
    kinds = ", ".join(f"('{c}','{k}')" for c, k in enc_kinds)
    feats = [c for c, _ in num if c != "target"]
    pairs = S.union_all([f"select '{a}' as col1, '{b}' as col2, abs({S.corr(a, b)}) as r from {src}"
                         for i, a in enumerate(feats) for b in feats[i + 1:]])
    full = " and ".join(f"({c} is not null and not isnan({c}))" if fl else f"{c} is not null"
                        for c, fl in [*num, *[(c, False) for c in cat]])
    return duck_with("train_view").rstrip() + f""",
      np as ({_num_profile_sql(src, num)}),
      cp as ({_cat_profile_sql(src, cat)}),
      tc as (select column_name, round(r,4) as corr from (
               select *, row_number() over (order by abs(r) desc, column_name) as rank
               from ({_corr_sql(src, 'target', TRAIN_NUM)}) c where r is not null) x where rank <= 10),
      oc as ({_outlier_sql(src, num)}),
      en as (select k.column_name, d.n_distinct,
               case when kind = 'string' then (case when n_distinct <= 20 then 'one_hot_encode'
                    else 'label_encode_or_drop' end)
                    else (case when n_distinct <= 10 then 'treat_as_categorical_or_keep'
                    else 'scale_numeric' end) end as recommendation
             from (values {kinds}) k(column_name, kind) join ({nd}) d using (column_name))
      {numeric}
      union all
      select 'categorical', column_name, 'top' || cast(rank as varchar), cast(cnt as double), value from cp
      union all
      {target}
      union all
      select 'correlation', column_name, 'corr', corr, cast(null as varchar) from tc
      union all
      select 'outliers', column_name, 'outlier_pct', outlier_pct, cast(null as varchar) from oc
      union all
      select 'collinear', col1, 'corr', round(r, 4), col2 from ({pairs}) pr where r > 0.9
      union all
      select 'shape', null, 'total_rows', cast(count(*) as double), null from {src}
      union all
      select 'shape', null, 'complete_rows', cast(count_if({full}) as double), null from {src}
      union all
      select 'shape', null, 'columns', {float(len(num) + len(cat))}, null
      union all
      select 'encoding', column_name, 'n_distinct', cast(n_distinct as double), recommendation from en"""


ORACLE["full_profile"] = _full_profile_sql()
