"""Quality rules (operator 3): a short-circuit cascade in native expressions.

``statistics`` adds the counts of every whole text. ``Cascade.fit`` takes a bounded sample,
measures each rule's cost (time of evaluating it) and selectivity (share of rows it
rejects), and orders the rules by rejections per cost; ``Cascade.apply`` evaluates them in
that order as one CASE expression, which stops at the first rule that rejects a row. The
order changes cost alone: a row is kept when no rule rejects it, in whatever order.

Repeated three-word windows are found per row: windows are hashed to 64 bits; a row whose
hashes are all distinct is done; in others, (hash, position) pairs are sorted, and windows
beside an equal hash are marked. That is O(n log n) for any text.

Defined cases: a null text has no words (all counts 0, base rule fails, not kept); empty
tables give empty tables; columns of the input are kept, those of the result's names
replaced; repeated rows are judged alike.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.llm.store import dropped, written

#: White space between words, as a character list and as a pattern.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Rows at most that costs and selectivities are estimated on.
SAMPLE_ROWS = 1000


def split_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds array columns through a generator, a boundary that expressions are not moved
    across: lambdas over a column would else compute its whole array for each element."""
    one = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(one)))


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add STATISTICS of ``text_col`` to ``df``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = _held(df.drop(*STATISTICS), __words=split_words(text), __lines=F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    n = F.size("__words")
    w = F.col("__words")
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    rows = _held(rows, __windows=windows)
    h = F.col("__windows")
    ranked = F.when(
        F.size(F.array_distinct(h)) < F.size(h),
        F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = _held(rows, __ranked=ranked)
    r = F.col("__ranked")
    beside = lambda x, k: (F.get(r, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(r, k + 1)["h"].eqNullSafe(x["h"]))
    rows = _held(rows, __at=F.sort_array(F.transform(F.filter(r, beside), lambda x: x["i"])))
    at = F.col("__at")
    covered = F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    lines = F.col("__lines")
    return rows.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in STATISTICS],
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(lines).cast("bigint").alias("n_lines"),
    )


@dataclass
class Rule:
    """Rejects the rows whose ``fails`` is true."""

    name: str
    fails: Column
    cost: float = 0.0
    rejects: float = 0.0


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules(text_col: str = "text") -> list[Rule]:
    """The rules in use. The limits follow published web-corpus filters and are kept wide, so
    that ordinary prose of any language passes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    capitals = F.regexp_count(text, F.lit(r"\p{Lu}"))
    lines = F.col("n_lines")
    return [
        Rule("too_short_or_repetitive", base_failed()),
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("word_length", (F.col("word_chars") > 20 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words"))),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > lines),
        Rule("few_letters", 10 * letters < 6 * F.col("word_chars")),
        Rule("capitals", 2 * capitals > letters),
        Rule("exclamations", 5 * F.regexp_count(text, F.lit("!")) > F.col("n_words")),
        Rule("ellipsis_lines", 10 * F.regexp_count(text, F.lit(r"(?:\.\.\.|…)[\x20\x09\x0B-\x0D]*(?:\n|$)")) > 3 * lines),
        Rule("bullet_lines", 10 * F.regexp_count(text, F.lit(r"(?:^|\n)[\x20\x09\x0B-\x0D]*[•‣◦*-][\x20\x09]")) > 9 * lines),
    ]


@dataclass
class Cascade:
    rules: list[Rule]
    order: list[Rule] = field(default_factory=list)

    def fit(self, sample: DataFrame) -> "Cascade":
        """Order the rules by rejections per cost on ``sample`` (statistics included), a
        bounded table that is read once per rule."""
        if not self.rules:
            return self
        one = F.lit(1)
        sums = sample.agg(F.count(one).alias("n"), *[F.coalesce(F.sum(r.fails.cast("int")), F.lit(0)).alias(f"r{i}") for i, r in enumerate(self.rules)]).first()
        for i, r in enumerate(self.rules):
            began = time.monotonic()
            sample.agg(F.max(r.fails)).first()
            r.cost = time.monotonic() - began
            r.rejects = sums[f"r{i}"] / max(sums["n"], 1)
        self.order = sorted(self.rules, key=lambda r: -r.rejects / max(r.cost, 1e-6))
        return self

    def first_failure(self) -> Column:
        """Name of the first rule in order that rejects the row, else null. CASE evaluates
        no branch behind the first true one."""
        out = None
        for r in self.order or self.rules:
            hit = F.coalesce(r.fails, F.lit(False))
            out = F.when(hit, r.name) if out is None else out.when(hit, r.name)
        return F.lit(None).cast("string") if out is None else out

    def apply(self, df: DataFrame, out: str = "kept") -> DataFrame:
        """Add ``out`` (boolean) and ``failed_rule`` to a table with its statistics."""
        return df.drop(out, "failed_rule").withColumn("failed_rule", self.first_failure()).withColumn(out, F.col("failed_rule").isNull())


def score(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics, ``kept`` and ``failed_rule`` of every row. The order of the rules is
    fitted on a sample of about ``sample_rows`` rows; the verdicts do not depend on it."""
    n = df.count()
    part = written(statistics(df.select(F.col(text_col).alias("text")).sample(min(1.0, sample_rows / max(n, 1)), 7), "text"), "quality-sample")
    order = [r.name for r in Cascade(rules("text")).fit(part).order]
    dropped(part)
    cascade = Cascade(sorted(rules(text_col), key=lambda r: order.index(r.name)))
    return cascade.apply(statistics(df, text_col))
