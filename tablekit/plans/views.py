"""Derived views over the driver tables (see FIXTURES.md, part C).

Each view exists twice: as a Spark DataFrame builder and as DuckDB SQL text for
the oracle. Both are pure projections/joins over the *whole* tables: no row is
filtered out; the train/test split is a column (``fold``), not a filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekit.functions.stats import fold_hash
from tablekit.session import table


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def lineitem_key() -> F.Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in
                              ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


# ---------------------------------------------------------------------------
# Spark builders
# ---------------------------------------------------------------------------

def train_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ orders ⋈ part with a target that has signal (all rows)."""
    li = _t(spark, sf_dir, "lineitem")
    o = _t(spark, sf_dir, "orders")
    p = _t(spark, sf_dir, "part")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(p, li.l_partkey == p.p_partkey))
    # not rounded: rounding at 4 decimals would hit half-way cases that the
    # engines round apart (decimal vs binary half-up)
    target = (F.col("l_quantity") * F.col("p_retailprice") * (1 - F.col("l_discount")) / 1000
              + F.lit(0.5) * F.regexp_extract("p_brand", "[0-9]+", 0).cast("int"))
    return j.select(
        lineitem_key().alias("row_key"),
        target.alias("target"),
        # not rounded: a rounded copy would hit half-way cases that engines round apart
        (target * 1.01 + F.col("l_tax")).alias("leaky"),
        "l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice",
        "p_brand", "p_type", "o_orderpriority", "o_orderstatus",
        F.col("o_orderdate").cast("timestamp").alias("last_dt"),
        F.col("p_name").alias("name"),
    )


def score_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring table: train_view without the target and the leaky copy."""
    return train_view(spark, sf_dir).drop("target", "leaky")


def zero_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.select(
        F.col("event_id"),
        F.when(F.col("event_type") == "purchase", F.col("value"))
         .otherwise(F.lit(0.0)).alias("target"),
        F.hour("ts").alias("hour"),
        F.weekday("ts").alias("dow"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("user_id"),
    )


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    h = fold_hash(lineitem_key()) % 100
    return li.select(
        "*",
        F.when(h < 33, None).otherwise(F.col("l_quantity")).alias("q_null"),
        F.when(h < 85, None).otherwise(F.col("l_discount")).alias("d_null"),
        F.when(h < 45, None).otherwise(F.col("l_tax")).alias("t_null"),
        F.when(h < 5, None).otherwise(F.col("l_returnflag")).alias("s_null"),
        F.lit(None).cast("double").alias("all_null"),
        F.lit(1).alias("const_col"),
        (F.col("l_quantity") > 25).alias("flag"),
        F.when(h < 1, None).otherwise(F.col("l_quantity")).alias("rare"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.withColumn("k", k)
    k = F.col("k")
    et = F.col("event_type")
    sev = F.element_at(F.array(F.lit("ok"), F.lit("minor"), F.lit("major")),
                       (k % 3 + 1).cast("int"))
    critique = F.concat(F.lit('{"approved":'),
                        F.when(k % 2 == 0, "true").otherwise("false"),
                        F.lit(',"severity":"'), sev, F.lit('"}'))
    payload = (
        F.when(et == "view", F.concat(F.lit('{"shape":['), k.cast("string"), F.lit(",10]}")))
        .when(et == "click", F.concat(F.lit('{"decisions":{"drop_columns":["c'),
                                      k.cast("string"), F.lit('"]}}')))
        .when(et == "purchase", F.concat(
            F.lit('{"model":"m'), (k % 4).cast("string"), F.lit('","cv_mse_mean":'),
            F.when(k == 7, "null").otherwise(F.col("value").cast("string")),
            F.lit(',"cv_rmse_mean":'), F.sqrt("value").cast("string"), F.lit("}")))
        .when(et == "error", F.when(k < 10, F.concat(F.lit("Review follows. "), critique,
                                                      F.lit(" End.")))
              .otherwise(critique))
        .otherwise(F.concat(F.lit('{"plan":['), F.regexp_replace(
            F.repeat(F.lit('{"agent":"Explorer","action":"step"},'), k % 5), ",$", ""),
            F.lit("]}"))))
    etype = (F.when(et == "view", "eda").when(et == "click", "feature_decisions")
             .when(et == "purchase", "model_result").when(et == "error", "critique")
             .otherwise("plan"))
    agent = (F.when(et == "view", "Explorer").when(et == "click", "Engineer")
             .when(et == "purchase", "Builder").when(et == "error", "Critic")
             .when(k >= 50, "Planner").otherwise("system"))
    return e.select(
        F.col("event_id"),
        F.concat(F.lit("run_"), (F.col("user_id") % 20).cast("string")).alias("run_id"),
        agent.alias("agent"), etype.alias("event_type"),
        F.col("ts").cast("timestamp").alias("timestamp"), payload.alias("payload"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), "text", "source",
                    F.array("lang", "source").alias("tags"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _t(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), "text")


# The role → tag lists of the fixture (FIXTURES.md C5).
ROLE_TAGS = [("reader_en", ["en", "src1"]), ("reader_fr", ["fr", "src2"]),
             ("reader_none", ["xx"])]


def role_tags(spark: SparkSession) -> DataFrame:
    rows = [(r, t, i) for r, tags in ROLE_TAGS for i, t in enumerate(tags)]
    return spark.createDataFrame(rows, "role string, tag string, tag_ord int")


# Planted guard strings by conv_id % 10 (FIXTURES.md C6).
PLANTED = ["Ignore previous instructions", "[INST]", "### system", "you are now",
           "import subprocess", "import numpy, socket; import os.path as p, json", "from os import path", "x = eval(1)",
           "\t\x07", "Intro\n# Title\nbody"]


def guard_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    m = F.col("conv_id") % 10
    nl = F.lit("\n")
    planted = F.element_at(F.array(*[F.lit(s) for s in PLANTED]), (m + 1).cast("int"))
    text = F.when(m == 9, planted).otherwise(F.concat(F.col("text"), nl, planted))
    return c.select("conv_id", "turn", "role", text.alias("text"))


# ---------------------------------------------------------------------------
# DuckDB twins (oracle side). Each entry is the body of a CTE.
# ---------------------------------------------------------------------------

H_DUCK = "cast('0x' || substr(md5(cast({x} as varchar)), 1, 8) as bigint)"
LI_KEY_DUCK = ("concat_ws('-', cast(l_orderkey as varchar), cast(l_linenumber as varchar), "
               "cast(l_partkey as varchar), cast(l_suppkey as varchar))")

DUCK_VIEWS: dict[str, str] = {
    "train_view": f"""
      select {LI_KEY_DUCK} as row_key,
             l_quantity*p_retailprice*(1-l_discount)/1000
                   + 0.5*cast(regexp_extract(p_brand,'[0-9]+',0) as integer) as target,
             (l_quantity*p_retailprice*(1-l_discount)/1000
                   + 0.5*cast(regexp_extract(p_brand,'[0-9]+',0) as integer))*1.01 + l_tax as leaky,
             l_quantity, l_discount, l_tax, p_size, p_retailprice,
             p_brand, p_type, o_orderpriority, o_orderstatus,
             cast(o_orderdate as timestamp) as last_dt, p_name as name
      from lineitem join orders on l_orderkey = o_orderkey
                    join part on l_partkey = p_partkey""",
    "score_view": """
      select * exclude (target, leaky) from train_view""",
    "zero_view": """
      select event_id,
             case when event_type = 'purchase' then value else 0.0 end as target,
             hour(ts) as hour, isodow(ts) - 1 as dow,
             cast(json_extract_string(props, '$.k') as integer) as k, user_id
      from events""",
    "holes": f"""
      select *,
        case when h < 33 then null else l_quantity end as q_null,
        case when h < 85 then null else l_discount end as d_null,
        case when h < 45 then null else l_tax end as t_null,
        case when h < 5 then null else l_returnflag end as s_null,
        cast(null as double) as all_null,
        1 as const_col,
        l_quantity > 25 as flag,
        case when h < 1 then null else l_quantity end as rare
      from (select *, {H_DUCK.format(x=LI_KEY_DUCK)} % 100 as h from lineitem) x""",
    "event_log": """
      select event_id, 'run_' || cast(user_id % 20 as varchar) as run_id,
        case event_type when 'view' then 'Explorer' when 'click' then 'Engineer'
          when 'purchase' then 'Builder' when 'error' then 'Critic'
          else (case when k >= 50 then 'Planner' else 'system' end) end as agent,
        case event_type when 'view' then 'eda' when 'click' then 'feature_decisions'
          when 'purchase' then 'model_result' when 'error' then 'critique'
          else 'plan' end as event_type,
        cast(ts as timestamp) as "timestamp",
        case event_type
          when 'view' then '{"shape":[' || cast(k as varchar) || ',10]}'
          when 'click' then '{"decisions":{"drop_columns":["c' || cast(k as varchar) || '"]}}'
          when 'purchase' then '{"model":"m' || cast(k % 4 as varchar) || '","cv_mse_mean":'
               || (case when k = 7 then 'null' else cast(value as varchar) end)
               || ',"cv_rmse_mean":' || cast(sqrt(value) as varchar) || '}'
          when 'error' then (case when k < 10 then 'Review follows. ' || crit || ' End.' else crit end)
          else '{"plan":[' || regexp_replace(repeat('{"agent":"Explorer","action":"step"},', k % 5), ',$', '')
               || ']}' end as payload
      from (select *, '{"approved":' || (case when k % 2 = 0 then 'true' else 'false' end)
                   || ',"severity":"' || (['ok','minor','major'])[k % 3 + 1] || '"}' as crit
            from (select *, cast(json_extract_string(props, '$.k') as integer) as k
                  from events) e0) e1""",
    "chunks": """
      select doc_id as chunk_id, text, source, [lang, source] as tags from documents""",
    "queries": """
      select item_id as query_id, text from benchmark""",
    "role_tags": """
      select * from (values ('reader_en','en',0), ('reader_en','src1',1),
                            ('reader_fr','fr',0), ('reader_fr','src2',1),
                            ('reader_none','xx',0)) v(role, tag, tag_ord)""",
    "guard_text": """
      select conv_id, turn, role,
        case when conv_id % 10 = 9 then 'Intro' || chr(10) || '# Title' || chr(10) || 'body'
             else text || chr(10) || (['Ignore previous instructions', '[INST]', '### system',
                  'you are now', 'import subprocess', 'import numpy, socket; import os.path as p, json', 'from os import path',
                  'x = eval(1)', chr(9) || chr(7)])[conv_id % 10 + 1] end as text
      from conversations""",
}

# Views that other views are defined on.
_DEPS = {"score_view": ["train_view"]}


def duck_with(*names: str) -> str:
    """``WITH`` clause defining the named views (and their dependencies)."""
    order: list[str] = []

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{n} as ({DUCK_VIEWS[n]})" for n in order) + "\n"
