"""Guard scans over text columns.

The rule lists are small fixed tables; each rule becomes one literal regex
expression (compiled once per task), evaluated in a single projection over the
text table. Per-rule summaries are one aggregate joined to the rule list so
rules with no hit still show 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Prompt-injection patterns, in order (first match is reported).
INJECTION_PATTERNS = [
    r"ignore\s+previous\s+instructions",
    r"disregard\s+all\s+prior",
    r"you\s+are\s+now",
    r"act\s+as\s+(a\s+)?(different|another|new)\s+(ai|assistant|model)",
    r"forget\s+everything",
    r"system\s*:\s*",
    r"<\s*/?system\s*>",
    r"<\s*/?prompt\s*>",
    r"\[INST\]",
    r"###\s*(system|instruction)",
]

# Dangerous-code patterns (case-sensitive, all matches listed).
CODE_PATTERNS = [
    r"\bos\.system\b",
    r"\bsubprocess\b",
    r"\beval\s*\(",
    r"\bexec\s*\(",
    r"\b__import__\s*\(",
    r"\bopen\s*\(.*['\"]w['\"]",
    r"\bsocket\b",
    r"\brequests\b",
    r"\burllib\b",
    r"\bshutil\.(rmtree|move|copy)",
    r"\bos\.(remove|unlink|rmdir|makedirs|system)",
    r"\bimport\s+ctypes",
    r"\bimport\s+subprocess",
]

# Import roots allowed in generated code.
ALLOWED_IMPORTS = [
    "pandas", "numpy", "sklearn", "scipy", "math", "statistics",
    "collections", "itertools", "functools", "json", "re",
    "pathlib", "typing", "dataclasses", "datetime", "copy",
    "warnings", "pprint", "io", "csv", "string", "random",
    "matplotlib", "seaborn",
]

# Model names accepted by the model-name check.
ALLOWED_MODELS = ["ridge", "random_forest", "gradient_boosting", "lightgbm", "xgboost",
                  "catboost", "ensemble", "logistic_regression"]

# Fixed value: what a blocked response is replaced by.
BLOCKED_MARKER = "[Response blocked by output guardrails]"

# An import statement at the start of a line or behind a semicolon: the list behind
# "import", or the module behind "from" (a relative one without a name has no root).
IMPORT_LIST = r"(?m)(?:^|;)[ \t]*import[ \t]+([^\n;#]+)"
IMPORT_FROM = r"(?m)(?:^|;)[ \t]*from[ \t]+\.*([A-Za-z_]\w*)"
MODULE_ROOT = r"^\s*\(?\s*([A-Za-z_]\w*)"


def rules_table(spark: SparkSession, patterns: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, p) for i, p in enumerate(patterns)],
                                 "rule_id int, pattern string")


def _hits(text: Column, patterns: list[str], case_insensitive: bool) -> list[Column]:
    flag = "(?i)" if case_insensitive else ""
    return [F.regexp_like(text, F.lit(flag + p)) for p in patterns]


def first_injection_rule(text: Column) -> Column:
    """Index of the first matching injection pattern, NULL when none.

    The reference lower-cases the text first, which makes the upper-case
    ``[INST]`` rule unreachable; case-insensitive matching keeps it live."""
    out = F.lit(None).cast("int")
    for i, h in reversed(list(enumerate(_hits(text, INJECTION_PATTERNS, True)))):
        out = F.when(h, F.lit(i)).otherwise(out)
    return out


def injection_flags(df: DataFrame, text_col: str = "text") -> DataFrame:
    """G1 per row: ``first_rule`` (NULL when clean) and ``flagged``."""
    fr = first_injection_rule(F.col(text_col))
    return df.withColumn("first_rule", fr).withColumn("flagged", fr.isNotNull())


def injection_scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """G1 per rule: rows where it is the first match, rows where it matches at
    all; every rule listed (0 when it never fires)."""
    hits = _hits(F.col(text_col), INJECTION_PATTERNS, True)
    fr = first_injection_rule(F.col(text_col))
    structs = [F.struct(F.lit(i).alias("rule_id"),
                        F.count_if(fr == i).cast("bigint").alias("n_first"),
                        F.count_if(h).cast("bigint").alias("n_any"))
               for i, h in enumerate(hits)]
    a = df.agg(F.array(*structs).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    rules = rules_table(df.sparkSession, INJECTION_PATTERNS)
    return F.broadcast(rules).join(a, "rule_id", "left").select(
        "rule_id", "pattern", F.coalesce("n_first", F.lit(0).cast("bigint")).alias("n_first"),
        F.coalesce("n_any", F.lit(0).cast("bigint")).alias("n_any"))


def sanitize_text(df: DataFrame, text_col: str = "text", max_length: int | None = None,
                  out: str | None = None) -> DataFrame:
    """Control characters → space over the whole text; ``max_length`` then cuts it, only
    where one is given."""
    clean = F.regexp_replace(F.col(text_col), r"[\x00-\x1f\x7f]", " ")
    if max_length is not None:
        clean = F.substring(clean, 1, max_length)
    return df.withColumn(out or text_col, clean)


def code_pattern_scan(df: DataFrame, text_col: str = "text", keys: list[str] = ()) -> DataFrame:
    """One row per (row, matching dangerous-code rule)."""
    hits = _hits(F.col(text_col), CODE_PATTERNS, False)
    ids = F.filter(F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(hits)]),
                   lambda x: x.isNotNull())
    return df.select(*keys, F.explode(ids).alias("rule_id")).select(
        *keys, "rule_id", F.element_at(F.array(*[F.lit(p) for p in CODE_PATTERNS]),
                                       F.col("rule_id") + 1).alias("pattern"))


def import_audit(df: DataFrame, text_col: str = "text", keys: list[str] = (),
                 allowed: list[str] = ALLOWED_IMPORTS) -> DataFrame:
    """Imported root modules that are not on the allow list, one row per imported name
    (``import a, b.c as d`` imports ``a`` and ``b``). Statements are found by pattern, as SQL
    has no syntax tree."""
    spark = df.sparkSession
    allow = spark.createDataFrame([(a,) for a in allowed], "module string")
    text = F.col(text_col)
    listed = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(IMPORT_LIST), 1), lambda x: F.split(x, ",")))
    roots = F.concat(F.transform(listed, lambda x: F.regexp_extract(x, MODULE_ROOT, 1)),
                     F.regexp_extract_all(text, F.lit(IMPORT_FROM), 1))
    mods = df.select(*keys, F.explode(roots).alias("module")).where("module <> ''")
    return mods.join(F.broadcast(allow), "module", "left_anti")


def allowed_value_check(df: DataFrame, col: str, allowed: list[str] = ALLOWED_MODELS) -> DataFrame:
    """Per distinct value, whether it is on the allow list, and its rows."""
    allow = df.sparkSession.createDataFrame([(a, True) for a in allowed], "__v string, __ok boolean")
    g = df.groupBy(F.col(col).cast("string").alias("value")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"))
    return (g.join(F.broadcast(allow), F.col("value") == F.col("__v"), "left")
             .select("value", F.coalesce("__ok", F.lit(False)).alias("allowed"), "n_rows"))


def response_gate(df: DataFrame, text_col: str = "text", out: str | None = None) -> DataFrame:
    """Flagged responses replaced by a fixed marker."""
    fr = first_injection_rule(F.col(text_col))
    return df.withColumn(out or text_col,
                         F.when(fr.isNotNull(), F.lit(BLOCKED_MARKER)).otherwise(F.col(text_col)))


def strip_preamble(df: DataFrame, text_col: str = "text", out: str | None = None) -> DataFrame:
    """Drop the lines before the first line starting with '#' (text kept
    when there is none)."""
    t = F.col(text_col)
    pos = F.instr(t, "\n#")
    res = (F.when(t.startswith("#"), t)
           .when(pos > 0, F.substring(t, pos + 1, 2 ** 31 - 1))
           .otherwise(t))
    return df.withColumn(out or text_col, res)
