"""Registered retrieval queries (R1-R14) and their DuckDB twins.

Chunks are the whole ``documents`` table, queries the whole ``benchmark`` texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekit.operators import retrieve as R
from tablekit.operators.blockmax import top_k
from tablekit.operators.segments import SegmentedIndex
from tablekit.plans import views as V
from tablekit.plans.views import duck_with
from tablekit.session import scratch_path, table


def _retriever(s, d):
    return R.Retriever.build(V.chunks(s, d))


def _conv_chunks(s, d):
    c = table(s, d, "conversations")
    return c.select("text", F.col("role").alias("source"), F.array("role").alias("tags"))


def _bm25_index(s, d):
    idx = R.bm25_index(V.chunks(s, d))
    return idx.terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _append(s, d):
    ch = V.chunks(s, d)
    idx = R.bm25_index(ch)
    terms, _ = R.append_bm25_terms(idx.terms, idx.stats, _conv_chunks(s, d).withColumn(
        "chunk_id", F.monotonically_increasing_id()))
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _turns(s, d):
    """Conversation turns as chunks whose ids follow those of the documents."""
    c = table(s, d, "conversations")
    chunk_id = F.lit(10**12) + F.col("conv_id").cast("bigint") * 10**4 + F.col("turn")
    return c.select(chunk_id.alias("chunk_id"), "text", F.col("role").alias("source"), F.array("role").alias("tags"))


def _append_index(s, d):
    """An index of the documents, appended to in two batches whose segments are then
    merged, answers as one built of everything."""
    turns = _turns(s, d)
    index = SegmentedIndex.build(V.chunks(s, d), scratch_path(s, "index"))
    index = index.append(turns.where("source = 'user'")).append(turns.where("source is distinct from 'user'"))
    index = index.merge(fewer_than=1 + turns.count())
    return top_k(index, V.queries(s, d)).select("query_id", "rank", "chunk_id", "score")


def _learn(s, d):
    ch = V.chunks(s, d)
    batch = ch.select("text", "source", "tags").unionByName(_conv_chunks(s, d))
    out = R.learn_from_results(ch, batch)
    return out.join(ch.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "text", "source")


def _corpus_size(s, d):
    ch = V.chunks(s, d)
    batch = ch.select("text", "source", "tags").unionByName(_conv_chunks(s, d))
    return R.corpus_size(R.learn_from_results(ch, batch))


def _pairs_rounded(df, col):
    return df.select("query_id", "chunk_id", F.round(col, 4).alias(col))


QUERIES = {
    "tokenize_keyword": lambda s, d: R.tokenize_keyword(V.chunks(s, d)),
    "bm25_index": _bm25_index,
    "bm25_score": lambda s, d: (lambda q: _pairs_rounded(R.bm25_score(
        R.bm25_index(V.chunks(s, d)), q, small_queries=R.query_batch_fits_broadcast(q)), "bm25"))(
        V.queries(s, d)),
    "tfidf_terms": lambda s, d: R.tfidf_terms(V.chunks(s, d))[1].select(
        "term", "df", F.round("idf", 6).alias("idf")),
    "tfidf_weights": lambda s, d: R.tfidf_index(V.chunks(s, d)).postings.select(
        "chunk_id", "term", F.round("w", 6).alias("w")),
    "tfidf_cosine": lambda s, d: (lambda q: _pairs_rounded(R.tfidf_cosine(
        R.tfidf_index(V.chunks(s, d)), q, small_queries=R.query_batch_fits_broadcast(q)), "tfidf"))(
        V.queries(s, d)),
    "hybrid_score": lambda s, d: _pairs_rounded(_retriever(s, d).hybrid(V.queries(s, d)), "score"),
    "retrieve_topk": lambda s, d: _retriever(s, d).retrieve(V.queries(s, d)),
    "retrieve_tag": lambda s, d: _retriever(s, d).retrieve(V.queries(s, d), tag="en"),
    "retrieve_for_role": lambda s, d: _retriever(s, d).retrieve_for_roles(
        V.queries(s, d), V.role_tags(s)),
    "retrieve_with_fallback": lambda s, d: _retriever(s, d).retrieve_with_fallback(
        V.queries(s, d), V.role_tags(s)),
    "context_string": lambda s, d: (lambda r: r.context(r.retrieve(V.queries(s, d))))(_retriever(s, d)),
    "append_chunks": _append,
    "append_index": _append_index,
    "learn_from_results": _learn,
    "corpus_size": _corpus_size,
}

# ---------------------------------------------------------------------------
# DuckDB twin: one CTE chain, each key selects from it.
# ---------------------------------------------------------------------------

_KW = "'[a-z0-9_]+'"
_WD = "'[\\p{L}\\p{N}_]{2,}'"


def _bm25_ctes(src: str, prefix: str = "b") -> str:
    p = prefix
    return f"""
  {p}kt as (select chunk_id, regexp_extract_all(lower(text), {_KW}) as toks from {src}),
  {p}post as (select term, chunk_id, dl, count(*) as tf
              from (select chunk_id, len(toks) as dl, unnest(toks) as term from {p}kt) x group by all),
  {p}stats as (select count(*) as n, avg(len(toks)) as avgdl from {p}kt),
  {p}raw as (select term, count(*) as df from {p}post group by term),
  {p}raw2 as (select term, df, ln((select n from {p}stats) - df + 0.5) - ln(df + 0.5) as idf from {p}raw),
  {p}terms as (select term, df, case when idf < 0 then 0.25 * (select avg(idf) from {p}raw2)
                                else idf end as idf from {p}raw2)"""


_BIGRAMS = "t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"

_CHAIN = duck_with("chunks", "queries", "role_tags").rstrip() + "," + _bm25_ctes("chunks") + f""",
  qkt as (select query_id, term, count(*) as qtf
          from (select query_id, unnest(regexp_extract_all(lower(text), {_KW})) as term from queries) x
          group by all),
  bm25 as (select query_id, chunk_id,
             sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (select avgdl from bstats)))) as bm25
           from qkt join bterms using (term) join bpost using (term) group by all),
  wt as (select chunk_id, {_BIGRAMS} as toks
         from (select chunk_id, regexp_extract_all(lower(text), {_WD}) as t from chunks) x),
  tc as (select term, chunk_id, count(*) as tf
         from (select chunk_id, unnest(toks) as term from wt) x group by all),
  tn as (select count(*) as n from chunks),
  tterms as (select term, df, ln((1 + n) / (1 + df)) + 1 as idf
             from (select term, count(*) as df from tc group by term) d, tn where df <= 0.95 * n),
  tw as (select term, chunk_id, (1 + ln(tf)) * idf as w from tc join tterms using (term)),
  tpost as (select term, chunk_id, w / sqrt(sum(w * w) over (partition by chunk_id)) as w from tw),
  qw0 as (select query_id, term, (1 + ln(qtf)) * idf as w
          from (select query_id, term, count(*) as qtf
                from (select query_id, unnest(toks) as term
                      from (select query_id, {_BIGRAMS} as toks
                            from (select query_id, regexp_extract_all(lower(text), {_WD}) as t
                                  from queries) a) b) c group by all) q
          join tterms using (term)),
  qv as (select query_id, term, w / sqrt(sum(w * w) over (partition by query_id)) as wq from qw0),
  tfidf as (select query_id, chunk_id, sum(w * wq) as tfidf from tpost join qv using (term) group by all),
  pairs as (select coalesce(b.query_id, t.query_id) as query_id, coalesce(b.chunk_id, t.chunk_id) as chunk_id,
                   coalesce(bm25, 0.0) as bm25, coalesce(tfidf, 0.0) as tfidf
            from bm25 b full outer join tfidf t on b.query_id = t.query_id and b.chunk_id = t.chunk_id),
  mx as (select query_id, greatest(max(bm25), 0) as mb, greatest(max(tfidf), 0) as mt from pairs group by 1),
  hyb as (select query_id, chunk_id, 0.4 * bm25 / (case when mb = 0 then 1 else mb end)
                 + 0.6 * tfidf / (case when mt = 0 then 1 else mt end) as score
          from pairs join mx using (query_id)),
  topk as (select query_id, rank, chunk_id, round(score, 4) as score from (
             select *, row_number() over (partition by query_id order by round(score, 6) desc, chunk_id) as rank
             from hyb where score > 0) x where rank <= 5),
  ct as (select chunk_id, tag from (select chunk_id, unnest(list_distinct(tags)) as tag from chunks) x
         where tag in (select tag from role_tags)),
  tp2 as (select p.*, tag from pairs p join ct using (chunk_id)),
  mx2 as (select query_id, tag, greatest(max(bm25), 0) as mb, greatest(max(tfidf), 0) as mt
          from tp2 group by all),
  pertag as (select query_id, tag, rank, chunk_id, round(score, 4) as score from (
               select *, row_number() over (partition by query_id, tag order by round(score, 6) desc, chunk_id) as rank
               from (select query_id, tag, chunk_id, 0.4 * bm25 / (case when mb = 0 then 1 else mb end)
                            + 0.6 * tfidf / (case when mt = 0 then 1 else mt end) as score
                     from tp2 join mx2 using (query_id, tag)) h where score > 0) x where rank <= 5),
  cand as (select r.role, r.tag_ord, p.*, c.text from pertag p join role_tags r using (tag)
           join chunks c using (chunk_id)),
  firsts as (select * from cand
             qualify row_number() over (partition by role, query_id, text order by tag_ord, rank) = 1),
  byrole as (select role, query_id, r as rank, chunk_id, score from (
               select *, row_number() over (partition by role, query_id order by score desc, tag_ord, rank) as r
               from firsts) x where r <= 5),
  fallback as (select * from byrole union all
               select m.role, t.query_id, t.rank, t.chunk_id, t.score
               from (select distinct role from role_tags) m cross join queries q
               join topk t on t.query_id = q.query_id
               where not exists (select 1 from byrole b where b.role = m.role and b.query_id = q.query_id))
"""


def _q(sel: str) -> str:
    return _CHAIN + sel


def _with_turns(sql: str) -> str:
    """The same over documents and conversation turns."""
    return sql.replace("from documents", """from documents union all
      select 1000000000000 + conv_id * 10000 + turn, text, role, [role] from conversations""", 1)


_CONV = "select text, role as source, [role] as tags from conversations"

ORACLE = {
    "tokenize_keyword": duck_with("chunks") + f"""select chunk_id, term, count(*) as tf
      from (select chunk_id, unnest(regexp_extract_all(lower(text), {_KW})) as term from chunks) x
      group by all""",
    "bm25_index": duck_with("chunks").rstrip() + "," + _bm25_ctes("chunks") +
        "\nselect term, df, round(idf, 6) as idf from bterms",
    "bm25_score": _q("select query_id, chunk_id, round(bm25, 4) as bm25 from bm25"),
    "tfidf_terms": _q("select term, df, round(idf, 6) as idf from tterms"),
    "tfidf_weights": _q("select chunk_id, term, round(w, 6) as w from tpost"),
    "tfidf_cosine": _q("select query_id, chunk_id, round(tfidf, 4) as tfidf from tfidf"),
    "hybrid_score": _q("select query_id, chunk_id, round(score, 4) as score from hyb"),
    "retrieve_topk": _q("select * from topk"),
    "retrieve_tag": _q("""select query_id, rank, chunk_id, round(score, 4) as score from (
        select *, row_number() over (partition by query_id order by round(score, 6) desc, chunk_id) as rank
        from (select query_id, chunk_id, 0.4 * bm25 / (case when mb = 0 then 1 else mb end)
                     + 0.6 * tfidf / (case when mt = 0 then 1 else mt end) as score
              from tp2 join mx2 using (query_id, tag) where tag = 'en') h where score > 0) x
        where rank <= 5"""),
    "retrieve_for_role": _q("select * from byrole"),
    "retrieve_with_fallback": _q("select * from fallback"),
    "context_string": _q("""select query_id, '--- Relevant knowledge ---' || chr(10)
        || string_agg('[' || cast(rank as varchar) || '] (' || source || ') ' || text, chr(10) order by rank)
        || chr(10) || '--- End of knowledge ---' as context
        from topk join chunks using (chunk_id) group by query_id"""),
    "append_chunks": duck_with("chunks").rstrip() + f""",
      allc as (select row_number() over () as chunk_id, text
               from (select text from chunks union all select text from ({_CONV}) c) u),""" +
        _bm25_ctes("allc", "a") + "\nselect term, df, round(idf, 6) as idf from aterms",
    "append_index": _with_turns(_q("select * from topk")),
    "learn_from_results": duck_with("chunks").rstrip() + f""",
      batch as (select text, source, tags from chunks union all {_CONV}),
      new as (select * from batch b where not exists (select 1 from chunks c where c.text = b.text))
      select (select max(chunk_id) from chunks) + row_number() over (order by source, text) as chunk_id,
             text, source from new""",
    "corpus_size": duck_with("chunks").rstrip() + f""",
      batch as (select text, source, tags from chunks union all {_CONV}),
      new as (select * from batch b where not exists (select 1 from chunks c where c.text = b.text))
      select cast((select count(*) from chunks) + (select count(*) from new) as bigint) as n_chunks""",
}
