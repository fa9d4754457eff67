"""Registered queries for the optional recipes (D1-D18) and their SQL twins."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablekit.operators import events as E
from tablekit.operators import extras as X
from tablekit.operators import model as M
from tablekit.operators.validate import with_counts
from tablekit.plans import sqlgen as S
from tablekit.plans import views as V
from tablekit.plans.feature_queries import round_doubles
from tablekit.plans.views import duck_with
from tablekit.session import table

_PRED = "l_quantity * p_retailprice / 1000"


def _type_consistency(s, d):
    train, test = V.train_view(s, d), V.score_view(s, d)
    return with_counts(with_counts(X.type_consistency(train, test), train, "train_"), test, "test_")


def _with_prediction(s, d):
    return V.train_view(s, d).withColumn("prediction", F.expr(_PRED))


#: Members of the registered ensembles: ridge models of different columns of the train view.
_MEMBERS = {"by_order": M.Member("ridge", ["l_quantity", "l_discount"]),
            "by_part": M.Member("ridge", ["p_retailprice", "p_size"])}
_ALPHA = M.RIDGE_ALPHA


def _oof(s, d):
    tv = V.train_view(s, d).select("row_key", "target", *[c for m in _MEMBERS.values() for c in m.features])
    return M.out_of_fold(tv, "target", "row_key", _MEMBERS)


def _weighted(s, d):
    oof = _oof(s, d)
    errors = M.member_errors(oof, "target", list(_MEMBERS))
    out = X.weighted_ensemble(oof, list(errors), list(errors.values()))
    return round_doubles(out.select("row_key", "prediction"))


def _stacking(s, d):
    return X.stacking(_oof(s, d), list(_MEMBERS), "target").select("member", F.round("weight", 4).alias("weight"))


def _cv_results(s, d):
    r = (E.typed_events(V.event_log(s, d), "model_result").where(F.col("cv_mse_mean").isNotNull())
         .groupBy("model").agg(F.avg("cv_mse_mean").alias("cv_mse_mean"),
                               F.stddev_pop("cv_mse_mean").alias("cv_mse_std")))
    return round_doubles(X.cv_instability(r))


def _unseen(s, d):
    train = table(s, d, "orders").select("o_orderstatus")
    test = table(s, d, "lineitem").select(F.col("l_returnflag").alias("o_orderstatus"))
    return X.unseen_categories(train, test, ["o_orderstatus"])


def _perm(s, d):
    tv = V.train_view(s, d).select("row_key", "target", "l_quantity", "p_retailprice", "l_discount")

    def score(df):
        return df.withColumn("prediction", F.expr(_PRED))
    return X.permutation_importance(tv, score, "target", ["l_quantity", "p_retailprice", "l_discount"],
                                    "row_key")


QUERIES = {
    "frequency_encode": lambda s, d: X.frequency_encode(
        table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority"),
    "winsorize": lambda s, d: round_doubles(X.winsorize(
        table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"),
        ["l_quantity", "l_extendedprice"])),
    "zscore_flags": lambda s, d: X.zscore_flags(table(s, d, "events"), ["value"]),
    "near_constant": lambda s, d: X.near_constant(
        V.holes(s, d), ["l_quantity", "l_tax", "const_col", "all_null"]),
    "spearman_leakage": lambda s, d: X.spearman_leakage(V.train_view(s, d), "target", "row_key"),
    "group_features_full": lambda s, d: round_doubles(X.group_features_full(
        V.train_view(s, d).select("row_key", "p_type", "p_retailprice", "l_quantity"), "p_type",
        ["p_retailprice", "l_quantity"])),
    "rank_in_group": lambda s, d: round_doubles(X.rank_in_group(
        table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"),
        "o_orderstatus", "o_totalprice", "o_orderkey")),
    "micro_market": lambda s, d: X.micro_market(table(s, d, "embeddings"), "embedding").select(
        "vec_id", "cluster"),
    "interactions": lambda s, d: round_doubles(X.interactions(
        table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                       "l_discount", "l_tax"),
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])),
    "calendar_extras": lambda s, d: X.calendar_extras(
        table(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "order").drop(
        "o_orderdate"),
    "out_of_fold": lambda s, d: round_doubles(_oof(s, d).drop("target")),
    "weighted_ensemble": _weighted,
    "stacking": _stacking,
    "cv_instability": _cv_results,
    "time_ordered_split": lambda s, d: X.time_ordered_split(
        table(s, d, "events").select("event_id", "ts"), "ts", "event_id").drop("ts"),
    "residual_profile": lambda s, d: X.residual_profile(_with_prediction(s, d), "target",
                                                        "prediction", "row_key"),
    "unseen_categories": _unseen,
    "type_consistency": _type_consistency,
    "collinear_drop": lambda s, d: X.collinear_drop(V.train_view(s, d), "target"),
    "rmsle": lambda s, d: X.rmsle(_with_prediction(s, d), "target"),
    "permutation_importance": _perm,
    "polynomial_features": lambda s, d: X.polynomial_features(
        table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"])
        .select("l_orderkey", "l_linenumber", F.size(vector_to_array("poly")).alias("n_terms")),
}

_TV = duck_with("train_view")
_TRAIN_NUM = ["leaky", "l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]


def _avg_rank(c):
    return (f"(rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0)")


def _spearman_sql():
    sel = ", ".join(f"{_avg_rank(c)} as r_{c}" for c in _TRAIN_NUM)
    parts = [f"select '{c}' as column_name, {S.corr('r_' + c, 'r_target')} as rho from rk"
             for c in _TRAIN_NUM]
    return _TV.rstrip() + f""",
      rk as (select {_avg_rank('target')} as r_target, {sel} from train_view)
      select column_name, round(rho, 4) as rho, abs(rho) > 0.9 as leakage_suspect
      from ({S.union_all(parts)}) x"""


def _ntile_sql(order: str, k: int) -> str:
    return f"ntile({k}) over (order by {order})"


def _oof_sql() -> str:
    """``oof``: two ridge models of two standardised columns each, by their normal equations."""
    ms = ["avg(target) as my"]
    pred = []
    for name, m in _MEMBERS.items():
        a, b = m.features
        z = {c: f"(t.{c} - s.m_{c}) / s.d_{c}" for c in (a, b)}
        ms += [f"avg({c}) as m_{c}, stddev_pop({c}) as d_{c}, count(*) * covar_pop({c}, target) / stddev_pop({c}) as t_{c}" for c in (a, b)]
        ms.append(f"count(*) * covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) as s_{name}")
        det = f"((s.n + {_ALPHA}) ** 2 - s.s_{name} ** 2)"
        pred.append(f"s.my + (((s.n + {_ALPHA}) * s.t_{a} - s.s_{name} * s.t_{b}) * {z[a]} "
                    f"+ ((s.n + {_ALPHA}) * s.t_{b} - s.s_{name} * s.t_{a}) * {z[b]}) / {det} as {name}")
    fold = "cast(cast('0x' || substr(md5('cv-' || row_key), 1, 8) as bigint) % 5 as integer)"
    return _TV.rstrip() + f""",
      t as (select *, {fold} as fold from train_view),
      s as (select f.fold, count(*) as n, {", ".join(ms)} from t, (select distinct fold from t) f
            where t.fold <> f.fold group by f.fold),
      oof as (select t.row_key, t.target, t.fold, {", ".join(pred)} from t join s on t.fold = s.fold) """


def _permutation_sql(features):
    mse = "avg((l_quantity * p_retailprice / 1000 - target) ** 2)"
    a = {c: f"a.{c}" for c in ("l_quantity", "p_retailprice", "l_discount")}
    each = []
    for c in features:
        v = a | {c: f"b.{c}"}
        each.append(f"select '{c}' as feature, round(avg(({v['l_quantity']} * {v['p_retailprice']} / 1000 - a.target) ** 2) "
                    f"- (select {mse} from train_view), 4) as mse_increase from a join b on a.i = b.i")
    return _TV.rstrip() + f""",
      a as (select *, row_number() over (order by row_key) as i from train_view),
      b as (select *, row_number() over (order by md5('42-' || row_key), row_key) as i from train_view)
      {S.union_all(each)}"""


_KINDS = {"row_key": "string", "l_quantity": "numeric", "l_discount": "numeric", "l_tax": "numeric",
          "p_size": "numeric", "p_retailprice": "numeric", "p_brand": "string", "p_type": "string",
          "o_orderpriority": "string", "o_orderstatus": "string", "last_dt": "datetime", "name": "string"}

ORACLE = {
    "type_consistency": duck_with("score_view") + S.with_counts(S.with_counts(
        "select column_name, kind as train_kind, kind as test_kind, true as consistent from (values "
        + ", ".join(f"('{c}', '{k}')" for c, k in _KINDS.items()) + ") v(column_name, kind)",
        "train_view", _KINDS, "train_"), "score_view", _KINDS, "test_"),
    "frequency_encode": """select o_orderpriority, o_orderkey,
        count(*) over (partition by o_orderpriority) as o_orderpriority_freq from orders""",
    "winsorize": """select l_orderkey, l_linenumber,
        round(greatest(q1 - 3 * (q3 - q1), least(l_quantity, q3 + 3 * (q3 - q1))), 4) as l_quantity,
        round(greatest(e1 - 3 * (e3 - e1), least(l_extendedprice, e3 + 3 * (e3 - e1))), 4) as l_extendedprice
        from lineitem, (select quantile_cont(l_quantity, 0.25) as q1, quantile_cont(l_quantity, 0.75) as q3,
                               quantile_cont(l_extendedprice, 0.25) as e1,
                               quantile_cont(l_extendedprice, 0.75) as e3 from lineitem) q""",
    "zscore_flags": """select 'value' as column_name,
        count_if(abs(value - m) / s > 3) as n_outliers
        from events, (select avg(value) as m, stddev_samp(value) as s from events) st""",
    "near_constant": duck_with("holes") + """select column_name, round(cv, 6) as cv from (
        select 'l_quantity' as column_name, stddev_samp(l_quantity) / nullif(abs(avg(l_quantity)), 0) as cv from holes
        union all select 'l_tax', stddev_samp(l_tax) / nullif(abs(avg(l_tax)), 0) from holes
        union all select 'const_col', stddev_samp(const_col) / nullif(abs(avg(const_col)), 0) from holes
        union all select 'all_null', stddev_samp(all_null) / nullif(abs(avg(all_null)), 0) from holes) c
        where cv < 0.01""",
    "spearman_leakage": _spearman_sql(),
    "group_features_full": _TV + """select row_key, p_type, round(p_retailprice, 4) as p_retailprice,
        round(l_quantity, 4) as l_quantity,
        round(avg(p_retailprice) over w, 4) as p_type__p_retailprice_mean,
        round(stddev_samp(p_retailprice) over w, 4) as p_type__p_retailprice_std,
        round(min(p_retailprice) over w, 4) as p_type__p_retailprice_min,
        round(max(p_retailprice) over w, 4) as p_type__p_retailprice_max,
        round(quantile_cont(p_retailprice, 0.5) over w, 4) as p_type__p_retailprice_median,
        round(avg(l_quantity) over w, 4) as p_type__l_quantity_mean,
        round(stddev_samp(l_quantity) over w, 4) as p_type__l_quantity_std,
        round(min(l_quantity) over w, 4) as p_type__l_quantity_min,
        round(max(l_quantity) over w, 4) as p_type__l_quantity_max,
        round(quantile_cont(l_quantity, 0.5) over w, 4) as p_type__l_quantity_median
        from train_view window w as (partition by p_type)""",
    "rank_in_group": """select o_orderkey, o_orderstatus, round(o_totalprice, 4) as o_totalprice,
        row_number() over (partition by o_orderstatus order by o_totalprice, o_orderkey) as row_number,
        rank() over (partition by o_orderstatus order by o_totalprice) as rank,
        round(percent_rank() over (partition by o_orderstatus order by o_totalprice), 4) as percent_rank
        from orders""",
    "interactions": "select l_orderkey, l_linenumber, " + ", ".join(
        [f"round({c}, 4) as {c}" for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]] +
        [x for a, b in [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"),
                        ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"),
                        ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]
         for x in (f"round({a} * {b}, 4) as {a}_x_{b}",
                   f"round(case when {b} = 0 then null else {a} / {b} end, 4) as {a}_per_{b}")]) +
        " from lineitem",
    "calendar_extras": """select o_orderkey, cast(dayofyear(o_orderdate) as integer) as order_dayofyear,
        cast(weekofyear(o_orderdate) as integer) as order_week,
        cast(month(o_orderdate) in (6, 7, 8) as integer) as order_peak_season from orders""",
    "out_of_fold": _oof_sql() + """select row_key, fold, round(by_order, 4) as by_order,
        round(by_part, 4) as by_part from oof""",
    "weighted_ensemble": _oof_sql() + """select row_key,
        round(by_order * ((1 / m1) / (1 / m1 + 1 / m2)) + by_part * ((1 / m2) / (1 / m1 + 1 / m2)), 4) as prediction
        from oof, (select avg((by_order - target) ** 2) as m1, avg((by_part - target) ** 2) as m2 from oof) m""",
    "stacking": _oof_sql() + """, m as (select count(*) as n, avg(by_order) as m1, avg(by_part) as m2, avg(target) as my,
          n * var_pop(by_order) + 1 as s11, n * var_pop(by_part) + 1 as s22, n * covar_pop(by_order, by_part) as s12,
          n * covar_pop(by_order, target) as t1, n * covar_pop(by_part, target) as t2 from oof),
        w as (select *, (s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12) as w1,
                     (s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12) as w2 from m)
        select 'by_order' as member, round(w1, 4) as weight from w
        union all select 'by_part', round(w2, 4) from w
        union all select 'intercept', round(my - w1 * m1 - w2 * m2, 4) from w""",
    "permutation_importance": _permutation_sql(["l_quantity", "p_retailprice", "l_discount"]),
    "cv_instability": duck_with("event_log") + r"""select model, round(avg(m), 4) as cv_mse_mean,
        round(stddev_pop(m), 4) as cv_mse_std, stddev_pop(m) > 0.2 * avg(m) as unstable
        from (select json_extract_string(o, '$.model') as model,
                     try_cast(json_extract_string(o, '$.cv_mse_mean') as double) as m
              from (select regexp_extract(payload, '(?s)\{.*\}', 0) as o from event_log
                    where event_type = 'model_result') x) y where m is not null group by model""",
    "time_ordered_split": f"""select event_id, cast({_ntile_sql('ts, event_id', 5)} as integer) as time_fold
        from events""",
    "residual_profile": _TV + f"""select decile, count(*) as n, round(avg(target - prediction), 4) as mean_residual,
        round(var_pop(target - prediction), 4) as var_residual
        from (select *, cast({_ntile_sql('prediction, row_key', 10)} as integer) as decile
              from (select row_key, target, {_PRED} as prediction from train_view) a) b group by decile""",
    "unseen_categories": """select 'o_orderstatus' as column_name, count(distinct v) as n_unseen_values,
        count(*) as n_unseen_rows from (select l_returnflag as v from lineitem where l_returnflag is not null) t
        where v not in (select o_orderstatus from orders where o_orderstatus is not null)""",
    "collinear_drop": _TV + f"""select col1, col2, case when ra < rb then col1 else col2 end as drop_column
        from (select 'leaky' as col1, 'l_quantity' as col2,
                     abs({S.corr('leaky', 'target')}) as ra, abs({S.corr('l_quantity', 'target')}) as rb
              from train_view) p
        where (select abs({S.corr('leaky', 'l_quantity')}) from train_view) > 0.9""",
    "rmsle": _TV + f"""select round(sqrt(avg((ln(1 + {_PRED}) - ln(1 + target)) ** 2)), 4) as rmsle
        from train_view""",
}
