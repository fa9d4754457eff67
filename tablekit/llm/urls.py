"""URL filters (operator 13) by a path-template tree, in native expressions.

A rule (verdict, host, path) fits its host and all subdomains where the url's path starts
with the rule's; of several the longest decides (of equally long ones the first by text).
Urls that a rule fits are the labels from which the tree learns a verdict for the others:

1. Masking: a path's parts between ``/`` and ``.`` that hold a digit become ``*``. ``judge``
   takes whole paths; ``learn`` alone, unless told ``levels=None``, shows a tree of ``LEVELS``
   segments, where the rest is ``**``. Urls are counted by (host, masked path) with their
   labels; all that follows works on these counts.
2. Generalising, level by level from the host: a segment stays only with ``min_pages`` pages
   and a ``min_share`` of its node's, else it is the wildcard ``*``. So a node has at most
   1 / min_share + 1 branches. Below a node of fewer than ``min_pages`` pages all segments
   are wildcards at once, so there are as many rounds as the deepest path that pages share.
3. Merging, from the lowest level up: a branch whose distribution over (what follows, label)
   is within a Hoeffding bound (ALERGIA's, on the total variation) of its siblings' joint one
   becomes ``{}``, one branch with all others that are.
4. A template is rejected when its smoothed purity (blocked + 1) / (labelled + 2) reaches
   ``min_purity`` and at least half of its pages are labelled, so that a few blocked pages
   never take a large unlabelled branch with them. Urls of no rejected template are allowed.

Counts are summed in the tasks before any shuffle, and a node's few frequent children are
joined to the counts as plain exchanges, which adaptive execution splits at a hot host. A
round takes only the paths that reach its level; it is written where a later one reads it.

Defined cases: a null url, or one without ``://``, has an empty host and path and is allowed;
an empty path is its own template; repeated rows count one by one; segments are compared as
they are written; extra columns pass through, and of the result's names the input's are
replaced; empty tables give empty tables.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekit.llm.store import written

LEVELS = 3
MIN_PAGES = 3
MIN_SHARE = 0.05
MIN_PURITY = 0.8
ALPHA = 0.05
RESULT = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty where there is none."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    part = lambda i: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def rule_of(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def masked(path: Column, levels: int | None = LEVELS) -> Column:
    """The path with ``*`` for each part that holds a digit, whole (``levels`` None) or cut
    after ``levels`` segments."""
    plain = F.regexp_replace(path, r"(?<![^/.])[^/.0-9]*+[0-9][^/.]*+", "*")
    if levels is None:
        return plain
    head = F.substring_index(plain, "/", levels + 1)
    return F.when(F.length(head) < F.length(plain), F.concat(head, F.lit("/**"))).otherwise(head)


def _generalised(counts: DataFrame, min_pages: int, min_share: float, levels: int | None) -> DataFrame:
    """Adds ``p``, the masked path with ``*`` for the rare segments of every level."""
    columns = ["host", "masked", "n", "n_block", "n_allow", "p"]
    deep = F.endswith("masked", F.lit("/**")) if levels is not None else F.lit(False)
    # the segments of the tree: one before the first slash, no ``**`` of a cut path
    segs = F.split("masked", "/", -1)
    tree = counts.withColumns({"p": F.lit(""), "segs": F.when(deep, F.slice(segs, 1, levels + 1)).otherwise(segs) if levels is not None else segs})
    done = tree.where(F.size("segs") < 2).select(*columns)
    tree, level = tree.where(F.size("segs") > 1), 1
    ended = []  # paths whose last segment is the node: pages of it, without a branch
    while True:
        # ``p`` has ``level`` - 1 segments; a path that ended there counts for its node
        seg = F.get("segs", F.lit(level))
        at = tree.withColumn("seg", seg)
        child = at.groupBy("host", "p", "seg").agg(F.sum("n").alias("c"))
        here = at.select("host", "p", "n")
        for x in ended or [done]:
            here = here.unionByName(x.select("host", "p", "n"))
        node = here.groupBy("host", "p").agg(F.sum("n").alias("total"))
        found = child.join(node, ["host", "p"]).select("host", "p", "seg", "total", ((F.col("c") >= min_pages) & (F.col("c") >= F.lit(min_share) * F.col("total"))).alias("stays"))
        rest = F.when(F.col("total") < min_pages, F.size("segs") - level).otherwise(F.lit(1))
        step = F.concat("p", F.when(F.col("stays"), F.concat(F.lit("/"), F.col("seg"))).otherwise(F.repeat(F.lit("/*"), rest)))
        last = (F.col("total") < min_pages) | (F.size("segs") == level + 1)
        out = written(at.join(found, ["host", "p", "seg"]).select("host", "masked", "n", "n_block", "n_allow", step.alias("p"), "segs", last.alias("is_done"), (F.size("segs") == level + 1).alias("ends_here")), f"url-level-{level}")
        done = done.unionByName(out.where("is_done").select(*columns))
        ended = [out.where("ends_here").select(*columns)]
        tree, level = out.where("not is_done").drop("is_done", "ends_here"), level + 1
        if not tree.take(1):
            break
    return done.withColumn("p", F.when(deep, F.concat("p", F.lit("/**"))).otherwise(F.col("p")))


def _merged(templates: DataFrame, alpha: float, levels: int | None) -> DataFrame:
    """(host, p, q): q is p with similar branches merged, from the level above a host's last
    one (its deepest path's, ``LEVELS`` at least; ``levels`` of cut paths)."""
    depth = templates.groupBy("host").agg(F.greatest(F.lit(LEVELS), F.max(F.size(F.split("p", "/", -1))) - 1).alias("depth"))
    if levels is not None:
        depth = depth.withColumn("depth", F.lit(levels))
    lowest = depth.agg(F.max("depth")).first()[0] or 1
    templates = templates.join(depth, "host")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), c.alias("c")) for k, c in (("block", F.col("n_block")), ("allow", F.col("n_allow")), ("open", F.col("n") - F.col("n_block") - F.col("n_allow")))]))
    rows = templates.select("host", "depth", "p", F.col("p").alias("q"), each.alias("x")).select("host", "depth", "p", "q", "x.label", "x.c").where("c > 0")
    for level in range(lowest - 1, 0, -1):
        parts = F.split("q", "/", -1)
        # shorter paths have no branch here: they stay, and count for no branch
        held = (F.size(parts) > level) & (F.col("depth") > level)
        short = rows.where(~held)
        rows = rows.where(held).withColumns({"up": F.array_join(F.slice(parts, 1, level), "/"), "branch": F.get(parts, F.lit(level)), "rest": F.array_join(F.slice(parts, level + 2, F.size(parts)), "/"), "more": F.size(parts)})
        node = ["host", "up"]
        total = lambda *c: F.sum("c").over(Window.partitionBy(*node, *c)).cast("double")
        sized = rows.withColumns({"all_n": total(), "branch_n": total("branch"), "sign_n": total("rest", "more", "label"), "own_n": total("branch", "rest", "more", "label")})
        others = F.nullif(F.col("all_n") - F.col("branch_n"), F.lit(0.0))  # none: no sibling
        excess = F.greatest(F.lit(0.0), F.col("own_n") / F.col("branch_n") - (F.col("sign_n") - F.col("own_n")) / others)
        far = F.sum(F.col("c") / F.col("own_n") * excess).over(Window.partitionBy(*node, "branch"))
        noise = F.lit(math.sqrt(0.5 * math.log(2 / alpha))) * (1 / F.sqrt("branch_n") + 1 / F.sqrt(others))
        similar = F.coalesce(F.col("far") <= noise, F.lit(False))
        joined = F.array_join(F.concat(F.slice(parts, 1, level), F.array(F.lit("{}")), F.slice(parts, level + 2, F.size(parts))), "/")
        rows = sized.withColumn("far", far).select("host", "depth", "p", F.when(similar, joined).otherwise(F.col("q")).alias("q"), "label", "c").unionByName(short)
        if level > 2:  # the last two levels are one plan
            rows = written(rows, f"url-merge-{level}")
    return rows.groupBy("host", "p", "q").agg(F.sum("c").alias("n"), *[F.sum(F.when(F.col("label") == k, F.col("c")).otherwise(0)).alias(f"n_{k}") for k in ("block", "allow")])


def learn(parsed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_purity: float = MIN_PURITY, alpha: float = ALPHA, levels: int | None = LEVELS) -> DataFrame:
    """(host, masked, template, n, n_block, n_allow, purity, rejected) of every masked path;
    the counts are the template's. ``parsed`` has host, path and the label ``verdict`` (null:
    none). ``levels``: segments of the tree, None for whole paths."""
    count = lambda k: F.sum(F.when(F.col("verdict") == k, 1).otherwise(0)).alias(f"n_{k}")
    counts = parsed.where("host <> ''").groupBy("host", masked(F.col("path"), levels).alias("masked")).agg(F.count(F.lit(1)).alias("n"), count("block"), count("allow"))
    tree = written(_generalised(written(counts, "url-counts"), min_pages, min_share, levels), "url-tree")
    templates = tree.groupBy("host", "p").agg(*[F.sum(c).alias(c) for c in ("n", "n_block", "n_allow")])
    merged = written(_merged(templates, alpha, levels), "url-templates")
    stats = merged.groupBy("host", "q").agg(*[F.sum(c).alias(c) for c in ("n", "n_block", "n_allow")])
    labelled = F.col("n_block") + F.col("n_allow")
    stats = stats.withColumn("purity", (F.col("n_block") + 1) / (labelled + 2)).withColumn("rejected", (F.col("purity") >= min_purity) & (2 * labelled >= F.col("n")))
    named = merged.select("host", "p", "q").join(stats, ["host", "q"])
    return tree.select("host", "masked", "p").join(named, ["host", "p"]).select("host", "masked", F.col("q").alias("template"), "n", "n_block", "n_allow", "purity", "rejected")


def judge(df: DataFrame, rules, url_col: str = "url", **settings) -> DataFrame:
    """``df`` with host, path, rule and verdict (block or allow) of each url, learned on and
    decided by whole paths unless ``levels`` is given."""
    levels = settings.setdefault("levels", None)
    columns = [F.col(f"`{c}`") for c in df.columns if c not in RESULT or c == url_col]
    host, path = host_and_path(F.col(f"`{url_col}`"))
    plain = df.select(F.struct(*columns).alias("row"), host.alias("host"), path.alias("path"))
    parsed = plain.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).select("row", "host", "path", "found.rule", "found.verdict")
    tree = learn(parsed.select("host", "path", "verdict"), **settings)
    bad = written(tree.where("rejected").select(F.col("host").alias("h"), F.col("masked").alias("m")), "url-rejected")
    known = parsed.where("verdict is not null or host = ''").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    open_ = parsed.where("verdict is null and host <> ''").withColumn("key", masked(F.col("path"), levels))
    judged = open_.join(bad, (F.col("host") == F.col("h")) & (F.col("key") == F.col("m")), "left")
    judged = judged.select("row", "host", "path", "rule", F.when(F.col("m").isNull(), F.lit("allow")).otherwise(F.lit("block")).alias("verdict"))
    return known.unionByName(judged).select("row.*", *RESULT)
