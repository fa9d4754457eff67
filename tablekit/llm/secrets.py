"""Secret scans (operator 4): an incremental ledger of blobs, in native expressions.

Every version of every path is named by the SHA-256 of its text. The ledger is a Parquet
table of scanned (blob, rule, rule version) pairs with their spans. A scan looks up which
pairs are new, scans one copy of each new blob with the rules it has not seen, appends the
results, and joins the findings of all blobs back to every path and version that has them.
Scanning the same history again, or with one new rule, reads only what is new.

Spans are code points, end exclusive, found without positions from the regex engine: a text
is split at a rule's matches, and the lengths of the pieces and matches add up.

Defined cases: a null text is the empty blob, without findings; repeated rows and equal
texts share a blob and each gets its findings; null paths and versions are kept; extra
columns pass through; empty tables give empty results and an empty ledger entry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekit.llm.store import new_path, written


@dataclass(frozen=True)
class Rule:
    """``pattern``: leftmost non-overlapping matches. ``keep`` tests (whole match, group 1,
    group 2) and drops failing matches. ``hint``: a cheaper pattern that every text with a
    kept match contains. ``rank``: place among kinds that start at the same position."""

    kind: str
    version: int
    pattern: str
    hint: str
    rank: int
    group: int = 0
    least: int = 0


# The base rules, then formats of well-known credentials.
RULES = [
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""", 0, 1, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{12}", 1, 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", r"[0-9a-f]{32}", 2, 0, 32),
    Rule("private_key", 1, r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----", r"PRIVATE KEY-----", 3),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"eyJ[A-Za-z0-9_-]{10,}\.", 4),
    Rule("forge_token", 1, r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{60,}|glpat-[A-Za-z0-9_-]{20,})", r"(?:gh[pousr]_|github_pat_|glpat-)", 5),
    Rule("service_token", 1, r"(?:xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", r"(?:xox[abprs]-|sk_live_|AIza)", 6),
    Rule("url_password", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\s:@/]{1,100}:[^\s:@/]{3,100}@", r"://[^\s:@/]{1,100}:[^\s:@/]{3,100}@", 7),
]
BASE_KINDS = ("assign", "access", "hex")
SPAN = "array<struct<start:int,end:int,rank:int,kind:string>>"
LEDGER = f"blob string, kind string, version int, spans {SPAN}"


def _spans(text: Column, rule: Rule) -> Column:
    """Spans of one rule's kept matches in ``text``, which holds its hint."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(F.transform(found, F.length).alias("m"), F.transform(tested, F.length).alias("g"), F.transform(between, F.length).alias("b"))
    none = F.array().cast("array<struct<start:int,end:int,ok:boolean>>")
    # the last part has no match behind it
    step = lambda a, p: F.when(p["m"].isNull(), a).otherwise(
        F.struct(
            (a["at"] + p["b"] + p["m"]).alias("at"),
            F.concat(a["s"], F.array(F.struct((a["at"] + p["b"]).alias("start"), (a["at"] + p["b"] + p["m"]).alias("end"), (p["g"] >= rule.least).alias("ok")))).alias("s"),
        )
    )
    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("s")), step)["s"]
    return F.transform(F.filter(walked, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(rule.rank).alias("rank"), F.lit(rule.kind).alias("kind")))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def new_ledger(spark: SparkSession, path: str | None = None) -> str:
    """An empty ledger in the shared folder."""
    path = path or new_path(spark, "secret-ledger")
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def scan(df: DataFrame, ledger: str, text_col: str = "text", rules: list[Rule] | None = None, out: str = "spans") -> DataFrame:
    """Add ``out`` (array of start, end, rank, kind; by start, then rank) to every row of
    ``df``; rows are versions of paths. Appends the newly scanned pairs to ``ledger``."""
    rules = RULES if rules is None else rules
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blobs = df.select(text.alias("text")).select("text", F.sha2(F.col("text"), 256).alias("blob"))
    version = {r.kind: r.version for r in rules}
    known = read_ledger(spark, ledger).where(" or ".join(f"(kind = '{k}' and version = {v})" for k, v in version.items()) or "false")
    known = known.groupBy("blob").agg(F.collect_set("kind").alias("seen"))
    # equal texts meet in the map tasks first: a text that a third of the rows share is one row a task
    fresh = blobs.groupBy("blob").agg(F.first("text").alias("text")).join(known, "blob", "left")
    fresh = fresh.where(F.col("seen").isNull() | (F.size("seen") < len(rules)))
    hit = lambda r: F.when(~F.coalesce(F.array_contains("seen", r.kind), F.lit(False)), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(F.col("text").rlike(r.hint), _spans(F.col("text"), r)).otherwise(F.array().cast(SPAN)).alias("spans")))
    entries = fresh.select("blob", F.inline(F.filter(F.array(*[hit(r) for r in rules]), lambda x: x.isNotNull())))
    entries.write.mode("append").parquet(ledger)
    return findings(df, ledger, text_col, rules, out)


def findings(df: DataFrame, ledger: str, text_col: str = "text", rules: list[Rule] | None = None, out: str = "spans") -> DataFrame:
    """Join the ledger's spans back to every row. Only blobs with spans are joined; they are
    written first, so that both sides of the join are plain exchanges that adaptive
    execution can split where many rows share a blob."""
    rules = RULES if rules is None else rules
    spark = df.sparkSession
    wanted = " or ".join(f"(kind = '{r.kind}' and version = {r.version})" for r in rules) or "false"
    hits = read_ledger(spark, ledger).where(F.size("spans") > 0).where(wanted).dropDuplicates(["blob", "kind", "version"])
    hits = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"))
    order = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    hits = written(hits.select("blob", F.array_sort(F.transform("found", order)).alias("found")), "secret-findings")
    rows = df.drop(out).withColumn("__blob", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    joined = rows.join(hits.withColumnRenamed("blob", "__blob").withColumnRenamed("found", "__found"), "__blob", "left")
    return joined.withColumn(out, F.coalesce("__found", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))).drop("__blob", "__found")


def digest(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined in their order."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every secret replaced; overlapping spans are replaced together."""
    text = F.coalesce(text, F.lit(""))
    step = lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
        F.struct(F.concat(a["out"], F.when(s["start"] >= a["at"], F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(F.lit(""))).alias("out"), s["end"].alias("at")))
    walked = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.lit(2**31 - 1))))
    return F.when(F.size(spans) == 0, text).otherwise(walked)
