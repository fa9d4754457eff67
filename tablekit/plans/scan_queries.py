"""Registered guard-scan queries (G1-G7) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekit.operators import scan as G
from tablekit.plans import views as V
from tablekit.plans.views import duck_with
from tablekit.session import table

_KEYS = ["conv_id", "turn"]
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _first_rule_sql() -> str:
    cases = " ".join(f"when regexp_matches(text, {_lit('(?i)' + p)}) then {i}"
                     for i, p in enumerate(G.INJECTION_PATTERNS))
    return f"(case {cases} end)"


QUERIES = {
    "injection_scan": lambda s, d: G.injection_scan(V.guard_text(s, d)),
    "injection_flags": lambda s, d: G.injection_flags(V.guard_text(s, d)).select(
        *_KEYS, F.coalesce("first_rule", F.lit(-1)).alias("first_rule"), "flagged"),
    "sanitize_text": lambda s, d: G.sanitize_text(V.guard_text(s, d)).select(*_KEYS, "text"),
    "code_pattern_scan": lambda s, d: G.code_pattern_scan(V.guard_text(s, d), keys=_KEYS),
    "import_audit": lambda s, d: G.import_audit(V.guard_text(s, d), keys=_KEYS),
    "allowed_value_check": lambda s, d: G.allowed_value_check(
        table(s, d, "orders"), "o_orderpriority", _PRIORITIES),
    "response_gate": lambda s, d: G.response_gate(V.guard_text(s, d)).select(*_KEYS, "text"),
    "strip_preamble": lambda s, d: G.strip_preamble(V.guard_text(s, d)).select(*_KEYS, "text"),
}

_GT = duck_with("guard_text")
_RULES = "(values " + ", ".join(f"({i}, {_lit(p)})" for i, p in enumerate(G.INJECTION_PATTERNS)) + \
    ") r(rule_id, pattern)"
_ALLOW = "(values " + ", ".join(f"({_lit(a)})" for a in G.ALLOWED_IMPORTS) + ") a(module)"

ORACLE = {
    "injection_scan": _GT + f"""select r.rule_id, r.pattern, coalesce(n_first, 0) as n_first,
        coalesce(n_any, 0) as n_any from {_RULES} left join (
          select rule_id, count_if(first_rule = rule_id) as n_first, count_if(hit) as n_any from (
            {" union all ".join(f"select {i} as rule_id, {_first_rule_sql()} as first_rule, regexp_matches(text, {_lit('(?i)' + p)}) as hit from guard_text" for i, p in enumerate(G.INJECTION_PATTERNS))}
          ) h group by rule_id) c using (rule_id)""",
    "injection_flags": _GT + f"""select conv_id, turn, cast(coalesce({_first_rule_sql()}, -1) as integer) as first_rule,
        {_first_rule_sql()} is not null as flagged from guard_text""",
    "sanitize_text": _GT + r"""select conv_id, turn,
        regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g') as text from guard_text""",
    "code_pattern_scan": _GT + " union all ".join(
        f"select conv_id, turn, {i} as rule_id, {_lit(p)} as pattern from guard_text "
        f"where regexp_matches(text, {_lit(p)})" for i, p in enumerate(G.CODE_PATTERNS)),
    # statement by statement with plain string functions, not the operator's patterns
    "import_audit": _GT + f"""select conv_id, turn, module from (
        select conv_id, turn, split_part(split_part(ltrim(x, ' '), ' ', 1), '.', 1) as module from (
          select conv_id, turn, case when starts_with(st, 'import ') then unnest(string_split(substring(st, 8), ','))
                                     when starts_with(st, 'from ') then substring(st, 6) end as x
          from (select conv_id, turn, trim(unnest(string_split(replace(text, ';', chr(10)), chr(10))), ' ' || chr(9)) as st
                from guard_text) a where starts_with(st, 'import ') or starts_with(st, 'from ')) b) c
        where regexp_full_match(module, '[A-Za-z_][A-Za-z0-9_]*') and module not in (select module from {_ALLOW})""",
    "allowed_value_check": f"""select cast(o_orderpriority as varchar) as value,
        coalesce(o_orderpriority in ({", ".join(_lit(p) for p in _PRIORITIES)}), false) as allowed,
        count(*) as n_rows from orders group by 1, 2""",
    "response_gate": _GT + f"""select conv_id, turn, case when {_first_rule_sql()} is not null
        then {_lit(G.BLOCKED_MARKER)} else text end as text from guard_text""",
    "strip_preamble": _GT + """select conv_id, turn, case when starts_with(text, '#') then text
        when instr(text, chr(10) || '#') > 0 then substring(text, instr(text, chr(10) || '#') + 1)
        else text end as text from guard_text""",
}
