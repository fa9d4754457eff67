"""Registered projection / filter / feature queries (P1-P9, F1-F15) and SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.operators import features as FE
from tablekit.operators.validate import with_counts
from tablekit.plans import sqlgen as S
from tablekit.plans import views as V
from tablekit.plans.views import duck_with
from tablekit.session import table


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Presentation step of a registered query: doubles rounded once, at the end."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def _missing_indicator_summary(df: DataFrame) -> DataFrame:
    cols = FE.fit_missing_indicators(df)
    x = FE.apply_missing_indicators(df, cols)
    structs = [F.struct(F.lit(c).alias("column_name"),
                        F.sum(F.col(f"{c}_was_missing").cast("bigint")).alias("n_flagged"))
               for c in cols]
    return x.agg(F.array(*structs).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def _group_choice(df: DataFrame, target: str) -> DataFrame:
    g, n = FE.choose_group_features(df, target)
    rows = [("group", c, i) for i, c in enumerate(g)] + [("numeric", c, i) for i, c in enumerate(n)]
    return df.sparkSession.createDataFrame(rows, "role string, column_name string, position int")


_GROUPS = ["p_brand", "p_type", "o_orderpriority"]
_NUMS = ["p_retailprice", "p_size", "l_quantity"]


def _group_features(s, d):
    tv = V.train_view(s, d)
    out = FE.group_features(tv, "target", _GROUPS, _NUMS)
    return round_doubles(out.select("row_key", *[f"{g}__{n}_{k}" for g in _GROUPS for n in _NUMS
                                                 for k in ("mean", "std")]))


_DECISIONS = FE.FeatureDecisions(
    drop_columns=["l_comment", "l_shipdate", "l_linestatus"],
    encode_columns=["l_returnflag"], scale_columns=["l_tax", "l_extendedprice"],
    log_transform_columns=["l_extendedprice"],
    interaction_features=["l_quantity*l_discount", "l_extendedprice/l_quantity"])

QUERIES = {
    "drop_columns": lambda s, d: FE.drop_columns(table(s, d, "lineitem"), ["l_tax", "l_comment"],
                                                 "l_extendedprice"),
    "drop_id_columns": lambda s, d: FE.drop_id_columns(table(s, d, "customer"), ["c_name", "name"]),
    "split_by_type": lambda s, d: with_counts(FE.split_by_type(table(s, d, "part")), table(s, d, "part")),
    "require_columns": lambda s, d: with_counts(
        FE.require_columns(table(s, d, "orders"), ["o_orderkey", "o_missing", "o_totalprice"]),
        table(s, d, "orders")),
    "filter_events": lambda s, d: FE.filter_events(V.event_log(s, d), "model_result", "Builder"),
    "filter_by_tag": lambda s, d: FE.filter_by_tag(V.chunks(s, d), "en").drop("tags"),
    "positive_subset": lambda s, d: FE.positive_subset(V.zero_view(s, d), "target"),
    "complete_rows": lambda s, d: FE.complete_rows(V.holes(s, d).drop("all_null")),
    "clip_range": lambda s, d: FE.clip_range(
        table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"),
        "l_extendedprice", 0.0, 365.0),
    "date_features": lambda s, d: round_doubles(FE.date_features(table(s, d, "orders"), "o_orderdate")),
    "cyclical_features": lambda s, d: round_doubles(FE.cyclical_features(
        table(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "order")
        .drop("o_orderdate")),
    "missing_indicators": lambda s, d: _missing_indicator_summary(V.holes(s, d)),
    "group_feature_choice": lambda s, d: _group_choice(V.train_view(s, d), "target"),
    "group_features": _group_features,
    "target_encode_oof": lambda s, d: round_doubles(FE.target_encode_oof(
        V.train_view(s, d), "p_brand", "target", "row_key").select("row_key", "p_brand_te")),
    "target_encode_apply": lambda s, d: round_doubles(FE.target_encode_apply(
        V.train_view(s, d), V.score_view(s, d), "p_brand", "target").select("row_key", "p_brand_te")),
    "median_impute": lambda s, d: round_doubles(FE.median_impute(
        V.holes(s, d).select("l_orderkey", "l_linenumber", "q_null", "t_null", "d_null", "rare",
                             "all_null"), ["q_null", "t_null", "d_null", "rare", "all_null"])),
    "mode_impute": lambda s, d: FE.mode_impute(
        V.holes(s, d).select("l_orderkey", "l_linenumber", "s_null"), ["s_null"]),
    "standard_scale": lambda s, d: round_doubles(FE.standard_scale(
        table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                       "l_discount", "l_tax"),
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])),
    "ordinal_encode": lambda s, d: FE.ordinal_encode(
        table(s, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"],
        suffix="_code"),
    "ordinal_encode_unseen": lambda s, d: FE.ordinal_encode(
        table(s, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"],
        fit_df=table(s, d, "lineitem").select(F.col("l_returnflag").alias("o_orderpriority")),
        suffix="_code"),
    "log_target": lambda s, d: round_doubles(FE.log_target(
        table(s, d, "events").select("event_id", "value"), "value", "log_value")),
    "prepare_table": lambda s, d: round_doubles(FE.prepare_table(V.train_view(s, d), "target",
                                                                 ["leaky"])),
    "apply_feature_decisions": lambda s, d: round_doubles(FE.apply_feature_decisions(
        table(s, d, "lineitem"), _DECISIONS)),
}


def _cyc(m, w, p):
    return [(f"sin(2*pi()*{m}/12)", f"{p}_month_sin"), (f"cos(2*pi()*{m}/12)", f"{p}_month_cos"),
            (f"sin(2*pi()*{w}/7)", f"{p}_dow_sin"), (f"cos(2*pi()*{w}/7)", f"{p}_dow_cos")]


def _r(expr, alias):
    return f"round({expr}, 4) as {alias}"


def _date_sql():
    ts = "cast(o_orderdate as timestamp)"
    dow = f"(isodow({ts}) - 1)"
    p = "last_review"
    cyc = ", ".join(_r(e, a) for e, a in _cyc(f"month({ts})", dow, p))
    return f"""select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) as o_totalprice,
      o_orderpriority,
      cast(floor((epoch_us(timestamp '2019-12-31') - epoch_us({ts})) / 86400e6) as bigint) as days_since_{p},
      cast(year({ts}) as integer) as {p}_year, cast(month({ts}) as integer) as {p}_month,
      cast({dow} as integer) as {p}_dow, cast(quarter({ts}) as integer) as {p}_quarter,
      coalesce(case when {dow} >= 5 then 1 else 0 end, 0) as {p}_is_weekend, {cyc}
      from orders"""


def _group_sql():
    sel, joins = [], []
    for g in _GROUPS:
        aggs = ", ".join(f"avg({n}) as {g}__{n}_mean, stddev_samp({n}) as {g}__{n}_std" for n in _NUMS)
        joins.append(f"left join (select {g}, {aggs} from train_view where {g} is not null group by {g}) "
                     f"s_{g} using ({g})")
        sel += [f"round({g}__{n}_{k}, 4) as {g}__{n}_{k}" for n in _NUMS for k in ("mean", "std")]
    return duck_with("train_view") + f"select row_key, {', '.join(sel)} from train_view " + " ".join(joins)


H_CV = "cast('0x' || substr(md5('cv-' || row_key), 1, 8) as bigint) % 5"

_TE_OOF = duck_with("train_view").rstrip() + f""",
  b as (select *, coalesce(cast(p_brand as varchar), 'nan') as cat, {H_CV} as fold from train_view),
  gm as (select avg(target) as gm from b),
  per as (select cat, fold, sum(target) as s, count(target) as n from b group by 1, 2),
  st as (select cat, fold, sum(s) over (partition by cat) - s as s_out,
                sum(n) over (partition by cat) - n as n_out from per)
  select row_key, round(coalesce((s_out + 20.0 * gm) / (n_out + 20.0), gm), 4) as p_brand_te
  from b left join st using (cat, fold), gm"""

_TE_APPLY = duck_with("train_view", "score_view").rstrip() + """,
  gm as (select avg(target) as gm from train_view),
  st as (select coalesce(cast(p_brand as varchar), 'nan') as cat,
                (sum(target) + 20.0 * (select gm from gm)) / (count(target) + 20.0) as enc
         from train_view group by 1)
  select row_key, round(coalesce(enc, gm), 4) as p_brand_te
  from score_view left join st on coalesce(cast(p_brand as varchar), 'nan') = st.cat, gm"""


def _median_sql():
    cols = ["q_null", "t_null", "d_null", "rare", "all_null"]
    sel = ", ".join(f"round(coalesce({c}, (select quantile_cont({c}, 0.5) from holes)), 4) as {c}" for c in cols)
    return duck_with("holes") + f"select l_orderkey, l_linenumber, {sel} from holes"


def _scale_sql():
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    sel = ", ".join(
        f"round(({c} - (select avg({c}) from lineitem)) / (select case when stddev_pop({c}) = 0 then 1.0 "
        f"else stddev_pop({c}) end from lineitem), 4) as {c}" for c in cols)
    return f"select l_orderkey, l_linenumber, {sel} from lineitem"


def _ordinal_sql(col, src, fit_src, fit_col, keys):
    return f"""select {keys}, {col}, coalesce(code, -1) as {col}_code from {src}
      left join (select v, cast(row_number() over (order by v) - 1 as bigint) as code
                 from (select distinct cast({fit_col} as varchar) as v from {fit_src}
                       where {fit_col} is not null) d) c on cast({col} as varchar) = c.v"""


def _prepare_sql():
    ts = "last_dt"
    dow = f"(isodow({ts}) - 1)"
    p = "last_review"
    cyc = ", ".join(_r(e, a) for e, a in _cyc(f"month({ts})", dow, p))
    return duck_with("train_view") + f"""select row_key, l_quantity, l_discount, l_tax, p_size,
      p_retailprice, p_brand, p_type, o_orderpriority, o_orderstatus,
      cast(floor((epoch_us(timestamp '2019-12-31') - epoch_us({ts})) / 86400e6) as bigint) as days_since_{p},
      cast(year({ts}) as integer) as {p}_year, cast(month({ts}) as integer) as {p}_month,
      cast({dow} as integer) as {p}_dow, cast(quarter({ts}) as integer) as {p}_quarter,
      coalesce(case when {dow} >= 5 then 1 else 0 end, 0) as {p}_is_weekend, {cyc}
      from train_view"""


def _decisions_sql():
    lx = "ln(1 + l_extendedprice)"
    return f"""with x as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
        {lx} as l_extendedprice, l_discount, l_tax, l_returnflag,
        l_quantity * l_discount as l_quantity_x_l_discount,
        case when l_quantity = 0 then null else {lx} / l_quantity end as l_extendedprice_per_l_quantity
      from lineitem),
      codes as (select v, cast(row_number() over (order by v) - 1 as bigint) as code
                from (select distinct l_returnflag as v from lineitem where l_returnflag is not null) d),
      st as (select avg(l_tax) as mt, stddev_pop(l_tax) as st, avg({lx}) as me, stddev_pop({lx}) as se
             from lineitem)
      select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity, 4) as l_quantity,
        round((l_extendedprice - me) / (case when se = 0 then 1.0 else se end), 4) as l_extendedprice,
        round(l_discount, 4) as l_discount,
        round((l_tax - mt) / (case when st = 0 then 1.0 else st end), 4) as l_tax,
        coalesce(code, -1) as l_returnflag,
        round(l_quantity_x_l_discount, 4) as l_quantity_x_l_discount,
        round(l_extendedprice_per_l_quantity, 4) as l_extendedprice_per_l_quantity
      from x left join codes on x.l_returnflag = codes.v, st"""


ORACLE = {
    "drop_columns": "select * exclude (l_tax, l_extendedprice) from lineitem",
    "drop_id_columns": "select * exclude (c_name) from customer",
    "split_by_type": S.with_counts("""select * from (values ('p_partkey','numeric'), ('p_name','categorical'),
      ('p_brand','categorical'), ('p_type','categorical'), ('p_size','numeric'),
      ('p_retailprice','numeric')) v(column_name, kind)""", "part",
        ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "require_columns": S.with_counts("""select * from (values ('o_orderkey', true, null),
      ('o_missing', false, 'column ''o_missing'' not found'), ('o_totalprice', true, null))
      v(column_name, present, reason)""", "orders", S.ORDERS),
    "filter_events": duck_with("event_log") +
        "select * from event_log where event_type = 'model_result' and agent = 'Builder'",
    "filter_by_tag": duck_with("chunks") +
        "select chunk_id, text, source from chunks where list_contains(tags, 'en')",
    "positive_subset": duck_with("zero_view") + "select * from zero_view where target > 0",
    "complete_rows": duck_with("holes") + """select * exclude (h, all_null) from holes
      where q_null is not null and d_null is not null and t_null is not null and s_null is not null
        and rare is not null""",
    "clip_range": """select l_orderkey, l_linenumber,
      case when l_extendedprice is not null then greatest(0.0, least(l_extendedprice, 365.0)) end
        as l_extendedprice from lineitem""",
    "date_features": _date_sql(),
    "cyclical_features": "select o_orderkey, " + ", ".join(
        _r(e, a) for e, a in _cyc("month(o_orderdate)", "(isodow(o_orderdate) - 1)", "order"))
        + " from orders",
    "missing_indicators": duck_with("holes") + "select column_name, n_flagged from (" + S.union_all([
        f"select '{c}' as column_name, cast(sum(case when {c} is null {'or isnan(' + c + ')' if fl else ''} "
        f"then 1 else 0 end) as bigint) as n_flagged, avg(case when {c} is null "
        f"{'or isnan(' + c + ')' if fl else ''} then 1.0 else 0.0 end) as frac from holes"
        for c, fl in [("l_orderkey", False), ("l_partkey", False), ("l_suppkey", False),
                      ("l_linenumber", False), ("l_quantity", True), ("l_extendedprice", True),
                      ("l_discount", True), ("l_tax", True), ("l_returnflag", False),
                      ("l_linestatus", False), ("l_shipdate", False), ("q_null", True),
                      ("d_null", True), ("t_null", True), ("s_null", False), ("all_null", True),
                      ("const_col", False), ("flag", False), ("rare", True)]]) +
        ") m where frac > 0.01",
    "group_feature_choice": duck_with("train_view") + """
      select 'group' as role, column_name, cast(row_number() over (order by pos) - 1 as integer) as position
      from (select * from (values ('row_key',0), ('p_brand',1), ('p_type',2), ('o_orderpriority',3),
              ('o_orderstatus',4), ('last_dt',5), ('name',6)) v(column_name, pos)) c
      join (select 'row_key' as column_name, count(distinct row_key) as nd from train_view
            union all select 'p_brand', count(distinct p_brand) from train_view
            union all select 'p_type', count(distinct p_type) from train_view
            union all select 'o_orderpriority', count(distinct o_orderpriority) from train_view
            union all select 'o_orderstatus', count(distinct o_orderstatus) from train_view
            union all select 'last_dt', count(distinct last_dt) from train_view
            union all select 'name', count(distinct name) from train_view) d using (column_name)
      where nd > 2 and nd <= 50
      qualify row_number() over (order by pos) <= 3
      union all
      select 'numeric', column_name, cast(row_number() over (order by v desc, pos) - 1 as integer)
      from (select 'leaky' as column_name, var_samp(leaky) as v, 0 as pos from train_view
            union all select 'l_quantity', var_samp(l_quantity), 1 from train_view
            union all select 'l_discount', var_samp(l_discount), 2 from train_view
            union all select 'l_tax', var_samp(l_tax), 3 from train_view
            union all select 'p_size', var_samp(p_size), 4 from train_view
            union all select 'p_retailprice', var_samp(p_retailprice), 5 from train_view) n
      qualify row_number() over (order by v desc, pos) <= 3""",
    "group_features": _group_sql(),
    "target_encode_oof": _TE_OOF,
    "target_encode_apply": _TE_APPLY,
    "median_impute": _median_sql(),
    "mode_impute": duck_with("holes") + """select l_orderkey, l_linenumber,
      coalesce(s_null, (select s_null from holes where s_null is not null group by s_null
                        order by count(*) desc, s_null limit 1)) as s_null from holes""",
    "standard_scale": _scale_sql(),
    "ordinal_encode": f"""select p_partkey, p_brand, p_type,
        coalesce(b.code, -1) as p_brand_code, coalesce(t.code, -1) as p_type_code from part
      left join (select v, cast(row_number() over (order by v) - 1 as bigint) as code
                 from (select distinct p_brand as v from part where p_brand is not null) d) b on p_brand = b.v
      left join (select v, cast(row_number() over (order by v) - 1 as bigint) as code
                 from (select distinct p_type as v from part where p_type is not null) d) t on p_type = t.v""",
    "ordinal_encode_unseen": _ordinal_sql("o_orderpriority", "orders", "lineitem", "l_returnflag",
                                          "o_orderkey"),
    "log_target": "select event_id, round(value, 4) as value, round(ln(1 + value), 4) as log_value from events",
    "prepare_table": _prepare_sql(),
    "apply_feature_decisions": _decisions_sql(),
}
