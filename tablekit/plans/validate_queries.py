"""Registered validation queries (V1-V13) and their DuckDB twins."""

from __future__ import annotations

from tablekit.functions.joins import stored
from tablekit.operators import validate as VA
from tablekit.plans import sqlgen as S
from tablekit.plans import views as V
from tablekit.plans.profile_queries import HOLES_ALL, HOLES_FLOAT
from tablekit.plans.views import duck_with
from tablekit.session import table

ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"]
TRAIN_COLS = ["row_key", "target", "leaky", "l_quantity", "l_discount", "l_tax", "p_size",
              "p_retailprice", "p_brand", "p_type", "o_orderpriority", "o_orderstatus",
              "last_dt", "name"]
TRAIN_FLOAT = {"target", "leaky", "l_quantity", "l_discount", "l_tax", "p_retailprice"}
TRAIN_NUMERIC = ["target", "leaky", "l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]


def _nd(src, cols):
    return S.union_all([f"select '{c}' as column_name, count(distinct {S.q(c)}) as n_distinct "
                        f"from {src}" for c in cols])


def _id_like_sql(src, cols):
    names = ", ".join(f"('{c}', {str(VA._id_name(c)).lower()})" for c in cols)
    return f"""select d.column_name, 'id_like_column' as risk, 'medium' as severity,
      printf('uniqueness=%.2f', n_distinct / n_rows) as detail
      from ({_nd(src, cols)}) d join (values {names}) nm(column_name, by_name) using (column_name),
           (select count(*) as n_rows from {src}) n
      where by_name or n_distinct / n_rows > 0.95"""


def _miss(c, floats):
    return f"({S.q(c)} is null or isnan({S.q(c)}))" if c in floats else f"({S.q(c)} is null)"


def _missing_flags_sql(src, cols, floats):
    fr = S.union_all([f"select '{c}' as column_name, avg(case when {_miss(c, floats)} then 1.0 else 0.0 end) "
                      f"as frac from {src}" for c in cols])
    return f"""select column_name, round(frac, 4) as missing_frac,
      case when frac >= 0.8 then 'high_missing_rate' when frac >= 0.4 then 'moderate_missing_rate' end as risk,
      case when frac >= 0.8 then 'high' when frac >= 0.4 then 'medium' end as severity,
      case when frac >= 0.4 then printf('%.0f%% NaN', frac * 100) end as detail,
      frac = 1.0 as drop_candidate
      from ({fr}) m where frac > 0"""


def _const_sql(src, cols, floats):
    def cl(c):
        return S.clean(c, c in floats)
    return S.union_all([
        f"select '{c}' as column_name, 'constant_column' as risk, 'medium' as severity, "
        f"'0 or 1 unique value' as detail from {src} "
        f"having min({cl(c)}) is not distinct from max({cl(c)})" for c in cols])


def _leak_corr_sql(src, target, cols):
    parts = []
    for c in cols:
        x = f"coalesce({S.q(c)}, (select quantile_cont({S.q(c)}, 0.5) from {src}))"
        y = f"coalesce({S.q(target)}, (select quantile_cont({S.q(target)}, 0.5) from {src}))"
        parts.append(f"select '{c}' as column_name, abs({S.corr(x, y)}) as r from {src}")
    return f"""select column_name,
      case when r > 0.98 then 'near_perfect_correlation' else 'high_correlation' end as risk,
      case when r > 0.98 then 'high_leakage_risk' else 'warning' end as severity,
      printf('corr=%.4f', r) as detail from ({S.union_all(parts)}) c where r > 0.9"""


def _drop_candidates_sql(src, target, cols, floats):
    return f"""select column_name, arg_min(reason, o) as reason from (
      select column_name, 1 as o, 'id_like_column' as reason from ({_id_like_sql(src, cols)}) a
      union all
      select column_name, 2, 'all_missing' from ({_missing_flags_sql(src, cols, floats)}) b where drop_candidate
      union all
      select column_name, 3, 'constant_column' from ({_const_sql(src, cols, floats)}) c
    ) u group by column_name"""


_HOLES_FEATS = [c for c in HOLES_ALL if c != "l_extendedprice"]
_TRAIN_FEATS = [c for c in TRAIN_COLS if c != "target"]


def _dup_sql(src, cols):
    cl = ", ".join(S.q(c) for c in cols)
    return f"""select 'rows' as column_name, 'duplicate_rows' as risk,
      case when dup / n < 0.05 then 'medium' else 'high' end as severity,
      printf('%d duplicate rows (%.1f%%)', dup, dup / n * 100) as detail, dup as n_duplicates
      from (select cast(sum(c - 1) as bigint) as dup, sum(c) as n
            from (select count(*) as c from {src} group by {cl}) g) a where dup > 0"""


def _validation_report_sql():
    src, t = "train_view", "target"
    feats = _TRAIN_FEATS
    num_feats = [c for c in TRAIN_NUMERIC if c != t]
    rules = f"""
      select 'target' as section, '{t}' as column_name, 'target_check' as risk,
             case when count(*) = 0 or count({t}) = 0 or (count(*) - count({t})) / count(*) > 0.5
                       or stddev_samp({t}) = 0 then 'critical' else 'ok' end as severity,
             cast(null as varchar) as detail from {src}
      union all
      select 'target', '{t}', risk, severity, detail from (
        select 'low_cardinality_target' as risk, 'medium' as severity,
               printf('only %d unique values - might be classification', count(distinct {t})) as detail,
               count(distinct {t}) <= 10 as hit from {src}
        union all
        select 'high_skew_target', 'medium', printf('skewness=%.2f', {S.skew(t)}), abs({S.skew(t)}) > 2
        from {src}) tr where hit
      union all
      select 'id', column_name, risk, severity, detail from ({_id_like_sql(src, feats)}) i
      union all
      select 'missing', column_name, risk, severity, detail
      from ({_missing_flags_sql(src, feats, TRAIN_FLOAT)}) m where risk is not null
      union all
      select 'constant', * from ({_const_sql(src, feats, TRAIN_FLOAT)}) c
      union all
      select 'leakage', column_name, 'suspicious_name', 'warning', null from (values (null)) v(column_name)
        where false
      union all
      select 'leakage', * from ({_leak_corr_sql(src, t, num_feats)}) l
      union all
      select 'duplicates', column_name, risk, severity, detail from ({_dup_sql(src, TRAIN_COLS)}) d
      union all
      select 'schema', column_name, status, 'high', null from (
        select column_name, 'missing_in_test' as status from (values ('leaky')) v(column_name)) s
    """
    return duck_with("train_view", "score_view").rstrip() + f""",
      rules as ({rules}),
      reasons as (
        select column_name, risk, case risk when 'id_like_column' then 1 else 3 end as o from rules
        where risk in ('id_like_column', 'constant_column')
        union all
        select column_name, 'all_missing', 2 from ({_missing_flags_sql(src, feats, TRAIN_FLOAT)}) m where drop_candidate)
      select 'summary' as section, cast(null as varchar) as column_name, 'n_rows_train' as risk, 'info' as severity,
             cast(count(*) as varchar) as detail from {src}
      union all
      select 'summary', null, 'n_rows_test', 'info', cast(count(*) as varchar) from score_view
      union all
      select 'summary', null, 'n_features', 'info', '{len(feats)}'
      union all
      select 'kinds', column_name, kind, 'info', null from (
        {_kind_sql(src, [(c, "numeric") for c in num_feats] + [("last_dt", "datetime")],
                   [c for c in feats if c not in num_feats and c != "last_dt"])}) kd
      union all
      select * from rules
      union all
      select 'drop', column_name, arg_min(risk, o), 'info', null from reasons group by column_name
      union all
      select 'actions', column_name, risk, 'info',
             case risk when 'id_like_column' then 'drop ' || chr(39) || column_name || chr(39) || ' from modeling features (ID-like)'
                       when 'all_missing' then 'drop ' || chr(39) || column_name || chr(39) || ' (100% NaN)'
                       else 'drop constant column ' || chr(39) || column_name || chr(39) end from reasons
      union all
      select 'actions', column_name, risk, 'info',
             case risk when 'high_skew_target' then 'consider log-transform for target'
                       else 'deduplicate ' || split_part(detail, ' ', 1) || ' duplicate rows' end
      from rules where risk in ('high_skew_target', 'duplicate_rows')
      union all
      select 'verdict', null, 'can_proceed',
             case when bool_and(severity <> 'critical') then 'ok' else 'critical' end,
             case when bool_and(severity <> 'critical') then 'true' else 'false' end from rules"""


def _kind_sql(table_name, cols_kinds, rest):
    direct = " union all ".join(f"select '{c}' as column_name, '{k}' as kind" for c, k in cols_kinds)
    parts = []
    for c in rest:
        s = f"cast({S.q(c)} as varchar)"
        parts.append(f"""select '{c}' as column_name, count({s}) as nn,
          count(try_cast({s} as timestamp)) as n_dt, avg(length({s})) as avg_len,
          count(distinct {s}) as n_distinct from {table_name}""")
    return f"""{direct} union all
      select column_name, case when n_dt = nn then 'datetime-like' when avg_len > 50 then 'text-like'
        when n_distinct > 0 and n_distinct / greatest(nn, 1) > 0.9 then 'high-cardinality-object'
        else 'categorical' end from ({S.union_all(parts)}) k"""


def _schema_diff(s, d):
    train, test = table(s, d, "orders"), table(s, d, "lineitem")
    return VA.with_counts(VA.with_counts(VA.schema_diff(train, test, "o_totalprice"), train, "train_"), test, "test_")


QUERIES = {
    "target_checks": lambda s, d: VA.target_checks(V.holes(s, d), "q_null"),
    "target_checks_fatal": lambda s, d: VA.target_checks(V.holes(s, d), "d_null"),
    "target_risk": lambda s, d: VA.target_risk(V.zero_view(s, d), "target"),
    "schema_diff": _schema_diff,
    "feature_kind_map": lambda s, d: VA.feature_kind_map(table(s, d, "customer")),
    "feature_kind_map_documents": lambda s, d: VA.feature_kind_map(table(s, d, "documents")),
    "id_like_columns": lambda s, d: VA.id_like_columns(table(s, d, "orders")),
    "missingness_flags": lambda s, d: VA.missingness_flags(V.holes(s, d)),
    "constant_columns": lambda s, d: VA.constant_columns(V.holes(s, d)),
    "leakage_by_name": lambda s, d: VA.with_counts(VA.leakage_by_name(V.train_view(s, d), "leaky"),
                                                   V.train_view(s, d).select("target")),
    "leakage_by_correlation": lambda s, d: VA.leakage_by_correlation(V.train_view(s, d), "target"),
    "duplicate_rows": lambda s, d: VA.duplicate_rows(table(s, d, "documents").select("text", "lang")),
    "drop_candidates": lambda s, d: VA.drop_candidates(V.holes(s, d), "l_extendedprice"),
    "validation_report": lambda s, d: VA.validation_report(V.train_view(s, d), "target",
                                                           V.score_view(s, d)),
    "mandatory_drops": lambda s, d: VA.mandatory_drops(stored(V.train_view(s, d), "train-view"), "target"),
}

_LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

ORACLE = {
    "target_checks": duck_with("holes") + """select cast(count(*) as bigint) as n_rows,
      cast(count(*) - count(q_null) as bigint) as target_nulls,
      round((count(*) - count(q_null)) / count(*), 4) as null_pct, round(stddev_samp(q_null), 4) as std,
      true as can_proceed, cast(null as varchar) as reason from holes""",
    "target_checks_fatal": duck_with("holes") + """select cast(count(*) as bigint) as n_rows,
      cast(count(*) - count(d_null) as bigint) as target_nulls,
      round((count(*) - count(d_null)) / count(*), 4) as null_pct, round(stddev_samp(d_null), 4) as std,
      false as can_proceed,
      printf('target column is %.0f%% NaN', (count(*) - count(d_null)) / count(*) * 100) as reason
      from holes""",
    "target_risk": duck_with("zero_view") + f"""select 'target' as column_name, risk, severity, detail from (
      select 'low_cardinality_target' as risk, 'medium' as severity,
             printf('only %d unique values - might be classification', count(distinct target)) as detail,
             count(distinct target) <= 10 as hit from zero_view
      union all
      select 'high_skew_target', 'medium', printf('skewness=%.2f', {S.skew('target')}),
             abs({S.skew('target')}) > 2 from zero_view) r where hit""",
    "schema_diff": S.with_counts(S.with_counts("""with a as (select column_name, case when data_type in ('BIGINT','INTEGER','DOUBLE')
          then 'numeric' when data_type = 'VARCHAR' then 'string' when data_type like 'TIMESTAMP%'
          then 'datetime' else 'other' end as kind, table_name from information_schema.columns),
      j as (select coalesce(t.column_name, s.column_name) as column_name, t.kind as train_kind,
               s.kind as test_kind from (select * from a where table_name = 'orders') t
            full outer join (select * from a where table_name = 'lineitem') s using (column_name)),
      k as (select *, case when column_name = 'o_totalprice' then
                (case when test_kind is not null then 'target_in_test' else 'target' end)
              when test_kind is null then 'missing_in_test' when train_kind is null then 'unexpected_in_test'
              else 'both' end as status from j)
      select column_name, train_kind, test_kind, status,
        (select count_if(status = 'missing_in_test') >
                count_if(train_kind is not null and column_name <> 'o_totalprice') * 0.5 from k) as critical
      from k""", "orders", S.ORDERS, "train_"), "lineitem", _LI_COLS, "test_"),
    "feature_kind_map": _kind_sql("customer", [("c_custkey", "numeric"), ("c_nationkey", "numeric"),
                                               ("c_acctbal", "numeric")], ["c_name", "c_mktsegment"]),
    "feature_kind_map_documents": _kind_sql("documents", [("doc_id", "numeric"), ("n_chars", "numeric")],
                                            ["text", "lang", "source"]),
    "id_like_columns": _id_like_sql("orders", ORDERS_COLS),
    "missingness_flags": duck_with("holes") + _missing_flags_sql("holes", HOLES_ALL, HOLES_FLOAT),
    "constant_columns": duck_with("holes") + _const_sql("holes", HOLES_ALL, HOLES_FLOAT),
    "leakage_by_name": duck_with("train_view") + S.with_counts(
        """select 'target' as column_name, 'suspicious_name' as risk, 'warning' as severity,
      cast(null as varchar) as detail""", "train_view", ["target"]),
    "leakage_by_correlation": duck_with("train_view") + _leak_corr_sql(
        "train_view", "target", [c for c in TRAIN_NUMERIC if c != "target"]),
    "duplicate_rows": _dup_sql("documents", ["text", "lang"]),
    "drop_candidates": duck_with("holes") + _drop_candidates_sql(
        "holes", "l_extendedprice", _HOLES_FEATS, HOLES_FLOAT),
    "validation_report": _validation_report_sql(),
    "mandatory_drops": duck_with("train_view") + f"""
      select column_name from ({_drop_candidates_sql('train_view', 'target', _TRAIN_FEATS, TRAIN_FLOAT)}) a
      union
      select column_name from ({_leak_corr_sql('train_view', 'target', [c for c in TRAIN_NUMERIC if c != 'target'])}) b
        where severity = 'high_leakage_risk'
      union
      select column_name from ({_missing_flags_sql('train_view', _TRAIN_FEATS, TRAIN_FLOAT)}) c
        where missing_frac >= 0.8""",
}
