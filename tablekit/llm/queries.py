"""Registered queries of the operators, and DuckDB SQL where SQL can express them.

Each query applies one operator to its whole table and derives the digest columns.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekit.llm.store import documents, new_path


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablekit.llm import bpe

    path = tokenizer_file()
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path, form="binary", keep_text=False)
    both = bpe.decode(ids, path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload bytes and digest of responses are taken from the payloads read back; those of
    revisits from their headers, whose payloads are not in the archive."""
    from tablekit.llm import warc

    pages = documents(spark, sf_dir, "pages")
    folder = new_path(spark, "warc")
    warc.write_archive(pages, folder)
    kind = pages.schema["page_id"].dataType.simpleString()
    response = warc.read_archive(spark, folder).where("warc_type = 'response'").select(
        warc.urn_id("record_id", kind).alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast(kind).alias("refers_to"))
    revisit = warc.read_archive(spark, folder, payload=False).where("warc_type = 'revisit'").select(
        warc.urn_id("record_id", kind).alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"), F.lit("revisit").alias("record_type"), warc.urn_id("refers_to", kind).alias("refers_to"))
    return response.unionByName(revisit)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablekit.llm import quality

    scored = quality.score(documents(spark, sf_dir).select("doc_id", "text"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("base_failed"), "kept")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one version each, against a new ledger."""
    from tablekit.llm import secrets

    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"), secrets.new_ledger(spark))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in secrets.BASE_KINDS], F.sha2(secrets.digest(F.col("spans"), secrets.BASE_KINDS), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablekit.llm import jaccard

    return jaccard.near_dups(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablekit.llm import pack

    return piece_digests(pack.pack(documents(spark, sf_dir), tokenizer_file()))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablekit.llm import hnsw

    return hnsw.near_dups(documents(spark, sf_dir, "embeddings"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablekit.llm import html

    pages = html.extract(documents(spark, sf_dir, "pages").select("page_id", "url", "html"), out="text")
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablekit.llm import lines

    out = lines.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "text")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablekit.llm import langid

    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(~langid.held_out() & F.col("doc_id").isNotNull()))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablekit.llm import centroids

    found = centroids.cluster(documents(spark, sf_dir, "embeddings"))
    return centroids.with_totals(found).withColumnRenamed("id", "vec_id")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablekit.llm import resample

    return resample.resample(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablekit.llm import urls

    judged = urls.judge(documents(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


#: The query's rules: verdict, host and path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_jaccard": op5_jaccard,
    "op6_packing": op6_packing,
    "op7_embeddings": op7_embeddings,
    "op8_html": op8_html,
    "op9_lines": op9_lines,
    "op10_langid": op10_langid,
    "op11_centroids": op11_centroids,
    "op12_resample": op12_resample,
    "op13_urls": op13_urls,
}

def _url_sql(levels: int = 3) -> str:
    """The tree's levels written out: t(d) generalises segment d, m(d) merges branches."""
    far = "sqrt(0.5 * ln(2 / 0.05)) * (1 / sqrt(bn) + 1 / sqrt(an - bn))"
    sql = r"""with u as materialized (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
          regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
      r as materialized (select *, case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
          when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
          when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
          when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule,
          string_split(regexp_replace(path, '[^/.]*[0-9][^/.]*', '*', 'g'), '/') as l from u),
      k as materialized (select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' else 'open' end as label,
          list_aggregate(l[1:4], 'string_agg', '/') || case when len(l) > 4 then '/**' else '' end as m from r),
      t0 as (select host, m, label, count(*) as n, '' as p from k where host <> '' group by all)"""
    for d in range(1, levels + 1):
        sql += f""",
      g{d} as materialized (select *, string_split(m, '/')[{d + 1}] as seg from t{d - 1}),
      h{d} as (select host, p, seg, sum(n) as c, sum(sum(n)) over (partition by host, p) as total from g{d} group by host, p, seg),
      t{d} as materialized (select host, m, label, n, case when seg is null then p when c >= 3 and c >= 0.05::double * total then p || '/' || seg else p || '/*' end as p
          from g{d} left join h{d} using (host, p, seg))"""
    sql += f""",
      q{levels} as materialized (select host, m, label, n, case when m like '%/**' then p || '/**' else p end as q from t{levels})"""
    for d in range(levels - 1, 0, -1):
        sql += f""",
      a{d} as (select host, q, label, sum(n) as n, string_split(q, '/') as l from q{d + 1} group by host, q, label, string_split(q, '/')),
      b{d} as (select *, coalesce(list_aggregate(l[1:{d}], 'string_agg', '/'), '') as up, l[{d + 1}] as branch, coalesce(list_aggregate(l[{d + 2}:], 'string_agg', '/'), '') as rest, len(l) as more from a{d}),
      c{d} as (select *, cast(sum(case when branch is not null then n else 0 end) over (partition by host, up) as double) as an, cast(sum(n) over (partition by host, up, branch) as double) as bn,
          cast(sum(case when branch is not null then n else 0 end) over (partition by host, up, rest, more, label) as double) as sn, cast(sum(n) over (partition by host, up, branch, rest, more, label) as double) as own from b{d}),
      d{d} as (select *, sum(n / own * greatest(0.0, own / bn - (sn - own) / nullif(an - bn, 0))) over (partition by host, up, branch) as far from c{d}),
      e{d} as (select distinct host, q, case when branch is not null and an > bn and far <= {far}
          then list_aggregate(list_concat(l[1:{d}], ['{{}}'], l[{d + 2}:]), 'string_agg', '/') else q end as to_q from d{d}),
      q{d} as materialized (select host, m, label, n, to_q as q from q{d + 1} join e{d} using (host, q))"""
    return sql + """,
      s as (select host, q, sum(n) as n, coalesce(sum(n) filter (label = 'block'), 0) as nb, coalesce(sum(n) filter (label <> 'open'), 0) as nl from q1 group by all),
      x as (select distinct host, m from q1 join s using (host, q) where (nb + 1) / (nl + 2) >= 0.8::double and 2 * nl >= s.n)
      select page_id, host, path, rule, case when label <> 'open' then label when x.m is not null then 'block' else 'allow' end as verdict from k left join x using (host, m)"""


def _centroid_sql(rounds: int = 3) -> str:
    """The rounds written out: a(r) assigns, c(r + 1) are the floors of the means."""
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    sql = """with v as materialized (select vec_id, list_transform(embedding, lambda e: cast(floor(64 * cast(e as double)) as bigint)) as x from embeddings
        where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64),
      c0 as materialized (select row_number() over (order by h) - 1 as c, x from (select sha256('1:' || vec_id) as h, x from v where vec_id is not null order by h limit 16))"""
    for r in range(rounds + 1):
        sql += f""",
      a{r} as materialized (select v.vec_id, v.x, min((cast({far} as bigint), c.c)) as d from v, c{r} c group by all)"""
        if r < rounds:
            sql += f""",
      s{r} as (select d[2] as c, i, sum(x[i]) as s, count(*) as n from a{r}, unnest(range(1, 65)) as u(i) group by all),
      c{r + 1} as materialized (select c{r}.c, coalesce(m.x, c{r}.x) as x from c{r} left join (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as x from s{r} group by c) m on c{r}.c = m.c)"""
    return sql + f"""
      select vec_id, cast(d[2] as int) as cluster, d[1] as distance, cast(sum(d[1]) over (partition by d[2]) as bigint) as cluster_inertia,
             cast(sum(d[1]) over () as bigint) as inertia, sha256(list_aggregate(c.x, 'string_agg', ',')) as centroid_sha256
      from a{rounds} a join c{rounds} c on c.c = a.d[2]"""


ORACLE: dict[str, str] = {
    "op13_urls": _url_sql(),
    "op11_centroids": _centroid_sql(),
    "op12_resample": r"""
        with one as (select list(list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), cast(b as bigint)) order by b) as t from range(256) as r(b)),
        d as (select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        f as materialized (select k, w, count(*) as n from (select k, unnest(w) as w from d) group by all),
        g as materialized (select w, count(*) as n from (select unnest(w) as w from b) group by w),
        words as (select distinct w, hex(encode(w)) as h from (select w from f union select w from g)),
        hashed as materialized (select w, xor(list_reduce(list_transform(range(1, len(h) // 2 + 1), lambda i: cast(cast('0x' || h[2 * i - 1 : 2 * i] as int) as bigint)),
                    lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]), 4294967295), 4294967295) % 10000 as bucket from words, one),
        s as (select bucket, sum(n) as s from f join hashed using (w) group by bucket),
        t as (select bucket, sum(n) as t from g join hashed using (w) group by bucket),
        gain as materialized (select bucket, floor(1000 * ln(cast(coalesce(t, 0) + 1 as double) * ((select coalesce(sum(s), 0) from s) + 10000) / (cast(s + 1 as double) * ((select coalesce(sum(t), 0) from t) + 10000)))) as g from s left join t using (bucket)),
        x as (select k, sum(n * g) as weight from f join hashed using (w) join gain using (bucket) group by k),
        y as (select doc_id, cast(len(w) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
                     cast(('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8)) as bigint) as h from d left join x using (k)),
        z as (select doc_id, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) as bigint) as score from y),
        r as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id is null, doc_id, weight, n_features) as r from z)
        select doc_id, n_features, weight, score, case when n_features >= 20 and r <= (select 10 * count(*) // 100 from z where n_features >= 20) then r end as rank from r""",
    "op9_lines": r"""
        with d as (select row_number() over () as r, doc_id, text, string_split(text, chr(10)) as l from documents),
        t as (select r, doc_id, i, regexp_extract_all(l[i], '[^\x20\x09-\x0D]+') as w from d, unnest(range(1, len(l) + 1)) as u(i)),
        k as (select r, doc_id, i, len(w) || ' ' || list_aggregate(list_transform(w, lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end), 'string_agg', ' ') as k
              from t where len(w) >= 3 and len(list_filter(w, lambda x: not regexp_matches(x, '[0-9]'))) > 0),
        r as (select k, min((doc_id, i)) as first from k group by k having count(distinct r) >= 3),
        x as (select doc_id, list(i) as gone from k join r using (k) where (doc_id, i) <> first group by doc_id)
        select doc_id, cast(coalesce(len(l), 0) as bigint) as n_lines, cast(coalesce(len(gone), 0) as bigint) as n_dropped,
               case when gone is null then text
                    else coalesce(list_aggregate(list_transform(list_filter(range(1, len(l) + 1), lambda i: not list_contains(gone, i)), lambda i: l[i]), 'string_agg', chr(10)), '') end as text
        from d left join x using (doc_id)""",
    "op3_quality": r"""
        with d as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents),
        a as (select k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
        g as (select k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from a, unnest(range(1, len(w) - 1)) as u(i)),
        c as (select k, i, count(*) over (partition by k, g) as n from g),
        r as (select k, count(distinct p) as n from c, unnest([i, i + 1, i + 2]) as u(p) where n > 1 group by k),
        s as (select doc_id, t, len(w) as n_words, length(list_aggregate(w, 'string_agg', '')) as c1,
                     len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines,
                     coalesce(r.n, 0) as n_repeat_words, len(regexp_extract_all(t, '\p{L}')) as letters, len(regexp_extract_all(t, '\p{Lu}')) as capitals
              from a left join r using (k)),
        f as (select *, coalesce(c1, 0) as word_chars, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s)
        select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
               cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
               not (base_failed or 10 * n_symbols > n_words or word_chars > 20 * n_words or word_chars < 2 * n_words
                    or 2 * n_dup_lines > n_lines or 10 * letters < 6 * word_chars or 2 * capitals > letters
                    or 5 * len(regexp_extract_all(t, '!')) > n_words
                    or 10 * len(regexp_extract_all(t, '(?:\.\.\.|…)[\x20\x09\x0B-\x0D]*(?:\n|$)')) > 3 * n_lines
                    or 10 * len(regexp_extract_all(t, '(?:^|\n)[\x20\x09\x0B-\x0D]*[•‣◦*-][\x20\x09]')) > 9 * n_lines) as kept
        from f""",
    "op2_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as h from pages),
        f as (select h, min(page_id) as first from p where n >= 100 group by h)
        select page_id, cast(n as bigint) as payload_bytes, h as payload_digest,
               case when first is not null and page_id <> first then 'revisit' else 'response' end as record_type,
               case when first is not null and page_id <> first then first end as refers_to
        from p left join f using (h)""",
}
