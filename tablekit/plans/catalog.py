"""The registry of queries: key → (spark, sf_dir) → DataFrame, and the SQL twins."""

from __future__ import annotations

import importlib

_MODULES = [
    "tablekit.plans.profile_queries",
    "tablekit.plans.validate_queries",
    "tablekit.plans.feature_queries",
    "tablekit.plans.retrieve_queries",
    "tablekit.plans.event_queries",
    "tablekit.plans.scan_queries",
    "tablekit.plans.model_queries",
    "tablekit.plans.source_queries",
    "tablekit.plans.extra_queries",
]


def _load():
    queries, oracle = {}, {}
    for name in _MODULES:
        m = importlib.import_module(name)
        queries.update(m.QUERIES)
        oracle.update(m.ORACLE)
    return queries, oracle


def prepare_session(spark) -> None:
    """Runtime settings every registered query relies on: UTC session time zone
    (timestamp parity with the SQL twins) and adaptive execution with skew-join
    splitting. Runtime confs only; nothing that needs a restart."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def _wrap(fn):
    def run(spark, sf_dir):
        prepare_session(spark)
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def all_queries():
    return {k: _wrap(v) for k, v in _load()[0].items()}


def _wrap_calls(sql: str, fname: str, template: str) -> str:
    """Rewrite every call ``fname(...)`` as ``template.format(call=...)``."""
    out, i, low, n = [], 0, sql.lower(), len(fname) + 1
    while True:
        j = low.find(fname + "(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(sql[i:j + n])
            i = j + n
            continue
        depth, k = 0, j + n - 1
        while k < len(sql):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _wrap_calls(sql[j + n:k], fname, template)
        out.append(sql[i:j] + template.format(call=sql[j:j + n] + inner + ")"))
        i = k + 1


def _normalise(sql: str) -> str:
    """Make DuckDB result types match Spark's: rounded values never -0.0
    (DuckDB keeps the sign of a rounded-away negative), counts as BIGINT
    (DuckDB's count_if / json_array_length give HUGEINT / UBIGINT)."""
    sql = _wrap_calls(sql, "round", "({call} + 0.0)")
    sql = _wrap_calls(sql, "count_if", "cast({call} as bigint)")
    sql = _wrap_calls(sql, "json_array_length", "cast({call} as bigint)")
    return sql


def all_oracle_sql():
    q, o = _load()
    return {k: _normalise(v) for k, v in o.items() if k in q}
