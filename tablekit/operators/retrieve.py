"""Text retrieval as joins: many queries × many chunks.

Index (built once, one shuffle each):
  * BM25 postings ``(term, chunk_id, tf, doc_len)`` — texts are dealt by chunk and
    tokenised and counted where they stand, so the shuffle carries texts, neither
    tokens nor postings (rows of one id are counted as one chunk); ``doc_len`` comes
    from the same row (``size`` of the token array), no extra join.
  * BM25 term table ``(term, df, idf)`` and a one-row ``(n_docs, avgdl)``.
  * TF-IDF postings ``(term, chunk_id, w)`` with ``w`` already L2-normalised per
    chunk, and the term table ``(term, df, idf)`` after the max-df cut.

Scoring: query terms (bounded by the query batch) are joined to the term
tables, size-checked and broadcast, then streamed against the postings with
no shuffle of the postings; the per-(query, chunk) sums are partially
aggregated. Per-query maxima are an aggregate joined back; top-k is
``row_number() <= k`` which Spark plans as a partial WindowGroupLimit, so a
query that matches every chunk still sends only k rows per map task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekit.functions.joins import BROADCAST_MAX_BYTES, bounded_broadcast, materialize, released, stored
from tablekit.functions.stats import NUMERIC_TYPES
from tablekit.session import scratch_path, shuffles_freed

# BM25 Okapi defaults, TF-IDF settings, hybrid weight and top-k.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
TFIDF_MAX_DF = 0.95
HYBRID_ALPHA = 0.4
TOP_K = 5
KEYWORD_PATTERN = "[a-z0-9_]+"
WORD_PATTERN = "[\\p{L}\\p{N}_]{2,}"


# ---------------------------------------------------------------------------
# tokenisation
# ---------------------------------------------------------------------------

def keyword_tokens(text: Column) -> Column:
    """Lower-case, then runs of [a-z0-9_]."""
    return F.regexp_extract_all(F.lower(text), F.lit(KEYWORD_PATTERN), 0)


def word_tokens(text: Column) -> Column:
    """R4 unigrams: lower-case runs of two or more Unicode word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), 0)


def with_bigrams(tokens: Column) -> Column:
    """Unigrams followed by adjacent pairs joined by a space. ``tokens`` should
    be a column reference (not the regex itself) so it is evaluated once."""
    m = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(tokens, 1, m), F.slice(tokens, 2, m),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tokens, pairs)


def term_counts(df: DataFrame, id_col: str, tokens: Column, out_id: str = "chunk_id",
                bigrams: bool = False, deal: bool = False) -> DataFrame:
    """(id, term, tf, doc_len) — one shuffle: of the counts, or (``deal``) of the texts, by id.

    The token array is computed in its own projection so expressions that use
    it several times (bigrams) do not re-run the regex."""
    if deal:
        # the group below holds the id in its key: all of it stays in the task
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)
    t = df.select(F.col(id_col).alias(out_id), tokens.alias("__toks"))
    if bigrams:
        t = t.select(out_id, with_bigrams(F.col("__toks")).alias("__toks"))
    # explode_outer + explicit filter: a plain explode lets the optimizer infer
    # size(tokens) > 0 and push that (the regex) below the repartition into the scan
    return (t.select(out_id, F.size("__toks").alias("doc_len"), F.explode_outer("__toks").alias("term"))
             .where(F.col("term").isNotNull())
             .groupBy(out_id, "term", "doc_len").agg(F.count(F.lit(1)).alias("tf")))


def tokenize_keyword(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """R1 as a table: (chunk_id, term, tf)."""
    return term_counts(chunks, id_col, keyword_tokens(F.col(text_col)), deal=True).drop("doc_len")


QUERY_BROADCAST_MAX_TERMS = 4_000_000


def query_batch_fits_broadcast(queries: DataFrame, text_col: str = "text",
                               max_terms: int = QUERY_BROADCAST_MAX_TERMS) -> bool:
    """Size check for the query side: one aggregate over the query table.
    Query-term tables (unigrams + bigrams) have at most 2 × tokens rows and the
    per-query maxima one row per query, so both are bounded by this count."""
    r = queries.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.size(word_tokens(F.col(text_col))) +
                          F.size(keyword_tokens(F.col(text_col)))).alias("t")).first()
    return (r["n"] or 0) <= max_terms and 2 * (r["t"] or 0) <= max_terms


def _maybe_broadcast(df: DataFrame, small: bool | None) -> DataFrame:
    if small is None:
        return bounded_broadcast(df)
    return F.broadcast(df) if small else df


#: A vocabulary is worked through in slices, so that of the postings' shuffle one slice is on
#: disk at a time: at most so many (each scans the postings), of so many postings or more.
TERM_SLICES = 8
SLICE_POSTINGS = 1_000_000


def _term_slices(postings: DataFrame) -> list[Column]:
    """Conditions on ``term``: its slices."""
    n = max(1, min(TERM_SLICES, -(-postings.count() // SLICE_POSTINGS)))
    return [F.pmod(F.xxhash64("term"), F.lit(n)) == i for i in range(n)]


def write_frequencies(postings: DataFrame, path: str) -> DataFrame:
    """(term, df) of written ``postings`` with a row per term and chunk, written to ``path``."""
    with shuffles_freed(postings.sparkSession):
        for own in _term_slices(postings):
            counts = postings.where(own).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            counts.write.mode("append").option("compression", "zstd").parquet(path)
    return postings.sparkSession.read.parquet(path)


def sliced_norms(postings: DataFrame, terms: DataFrame, chunk: list[str]) -> DataFrame:
    """(*chunk, norm): the L2 norm of each chunk's weights (1 + ln tf) * idf, of ``postings``
    (*chunk, term, tf) and ``terms`` (term, idf), both written; a term's idf meets its postings
    once. Written."""
    done = []
    for own in _term_slices(postings):
        w = postings.where(own).join(terms.where(own).select("term", "idf").hint("shuffle_hash"), "term")
        w = w.select(*chunk, ((1 + F.log("tf")) * F.col("idf")).alias("w"))
        done.append(stored(w.groupBy(*chunk).agg(F.sum(F.col("w") * F.col("w")).alias("squares")), "norm-squares"))
    squares = reduce(DataFrame.unionByName, done).groupBy(*chunk).agg(F.sqrt(F.sum("squares")).alias("norm"))
    out = stored(squares, "norms")
    for d in done:
        released(d)
    return out


# ---------------------------------------------------------------------------
# R2: BM25 index
# ---------------------------------------------------------------------------

@dataclass
class BM25Index:
    postings: DataFrame    # term, chunk_id, tf, doc_len
    terms: DataFrame       # term, df, idf
    stats: DataFrame       # one row: n_docs, avgdl


def bm25_terms_from_df(term_df: DataFrame, n_docs: Column) -> DataFrame:
    """idf = ln(N − df + .5) − ln(df + .5); negative idf → ε · mean idf (mean
    over all terms before the replacement). ``term_df`` has (term, df) and the
    column ``n_docs`` (one-row cross join)."""
    raw = term_df.withColumn("__idf", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("__idf").alias("__mean"))
    return (raw.crossJoin(F.broadcast(mean))
               .select("term", "df", F.when(F.col("__idf") < 0, F.lit(BM25_EPSILON) * F.col("__mean"))
                       .otherwise(F.col("__idf")).alias("idf")))


def bm25_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> BM25Index:
    toks = keyword_tokens(F.col(text_col))
    # stored once: the term table, the statistics and every scoring join
    # read the postings with different column subsets (no exchange reuse between
    # them), and each re-read would re-tokenise the corpus
    postings = stored(term_counts(chunks, id_col, toks, deal=True), "bm25-postings")
    n_docs = chunks.agg(F.count(F.lit(1)).alias("n_docs"))
    stats = (postings.agg(F.sum("tf").alias("__tok")).crossJoin(n_docs)
             .select("n_docs", (F.coalesce(F.col("__tok"), F.lit(0)) / F.col("n_docs")).alias("avgdl")))
    dfs = write_frequencies(postings, scratch_path(chunks.sparkSession, "bm25-terms"))
    terms = bm25_terms_from_df(dfs.crossJoin(F.broadcast(stats.select("n_docs"))), F.col("n_docs"))
    return BM25Index(postings, terms, stats)


def query_terms(queries: DataFrame, tokens: Column, id_col: str = "query_id",
                bigrams: bool = False) -> DataFrame:
    """(query_id, term, qtf): repeated query tokens counted, not duplicated."""
    return (term_counts(queries, id_col, tokens, "query_id", bigrams)
            .select("query_id", "term", F.col("tf").alias("qtf")))


def bm25_score(index: BM25Index, queries: DataFrame, id_col: str = "query_id",
               text_col: str = "text", small_queries: bool | None = None) -> DataFrame:
    """(query_id, chunk_id, bm25) for every chunk sharing a term with the query."""
    qt = query_terms(queries, keyword_tokens(F.col(text_col)), id_col)
    qw = (qt.join(index.terms, "term")              # query vocabulary only
            .select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("__qw")))
    qw = _maybe_broadcast(qw, small_queries)
    k1, b = F.lit(BM25_K1), F.lit(BM25_B)
    tf, dl = F.col("tf"), F.col("doc_len")
    part = (index.postings.join(qw, "term").crossJoin(F.broadcast(index.stats.select("avgdl")))
            .select("query_id", "chunk_id",
                    (F.col("__qw") * tf * (k1 + 1) /
                     (tf + k1 * (1 - b + b * dl / F.col("avgdl")))).alias("s")))
    return part.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("bm25"))


# ---------------------------------------------------------------------------
# TF-IDF
# ---------------------------------------------------------------------------

#: A chunk's id and norm in a broadcast table.
NORM_BYTES = 32


@dataclass
class TfidfIndex:
    counts: DataFrame      # term, chunk_id, tf
    terms: DataFrame       # term, df, idf (after the max-df cut)
    norms: DataFrame       # chunk_id, norm (L2 norm of the chunk's weight vector)
    stats: DataFrame       # one row: n_docs

    @property
    def postings(self) -> DataFrame:
        """R5 weights ``(term, chunk_id, w)``, L2-normalised per chunk. A row per chunk is
        broadcast while that takes little; else the postings move once more."""
        norms = self.norms
        plain = isinstance(self.counts.schema["chunk_id"].dataType, NUMERIC_TYPES)
        if plain and self.stats.first()["n_docs"] * NORM_BYTES <= BROADCAST_MAX_BYTES:
            norms = F.broadcast(norms)
        return (self.counts.join(self.terms.select("term", "idf"), "term")
                    .join(norms, "chunk_id")
                    .select("term", "chunk_id",
                            ((1 + F.log("tf")) * F.col("idf") / F.col("norm")).alias("w")))


def tfidf_terms(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text",
                max_df: float = TFIDF_MAX_DF) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunk_id, term, tf) counts, the kept vocabulary (term, df, idf) and N."""
    # stored once: read by the term table, the norms and the scoring join
    counts = term_counts(chunks, id_col, word_tokens(F.col(text_col)), bigrams=True, deal=True) \
        .drop("doc_len")
    counts = stored(counts, "tfidf-counts")
    stats = chunks.agg(F.count(F.lit(1)).alias("n_docs"))
    n = F.col("n_docs")
    terms = (write_frequencies(counts, scratch_path(chunks.sparkSession, "tfidf-terms"))
                   .crossJoin(F.broadcast(stats))
                   .where(F.col("df") <= F.lit(max_df) * n)
                   .select("term", "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")))
    return counts, terms, stats


def tfidf_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text",
                max_df: float = TFIDF_MAX_DF) -> TfidfIndex:
    """Weights (1 + ln tf) · idf; the per-chunk L2 norms are an aggregate
    (no sort), written once, applied only to the postings a query touches."""
    counts, terms, stats = tfidf_terms(chunks, id_col, text_col, max_df)
    return TfidfIndex(counts, terms, sliced_norms(counts, terms, ["chunk_id"]), stats)


def tfidf_query_vectors(index: TfidfIndex, queries: DataFrame, id_col: str = "query_id",
                        text_col: str = "text") -> DataFrame:
    """Query weights ``(query_id, term, wq, idf)``, L2-normalised per query."""
    qt = query_terms(queries, word_tokens(F.col(text_col)), id_col, bigrams=True)
    w = (qt.join(index.terms.select("term", "idf"), "term")
           .select("query_id", "term", "idf", ((1 + F.log("qtf")) * F.col("idf")).alias("w")))
    nq = Window.partitionBy("query_id")   # rows of one query: its distinct terms
    return w.select("query_id", "term", "idf",
                    (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(nq))).alias("wq"))


def tfidf_cosine(index: TfidfIndex, queries: DataFrame, id_col: str = "query_id",
                 text_col: str = "text", small_queries: bool | None = None) -> DataFrame:
    """(query_id, chunk_id, tfidf) — sparse dot product as a join on term.

    The raw counts are streamed against the (broadcast) query vectors, so only
    postings of query terms go on; they meet the chunk norms afterwards."""
    qv = _maybe_broadcast(tfidf_query_vectors(index, queries, id_col, text_col), small_queries)
    dots = (index.counts.join(qv, "term")
                 .groupBy("query_id", "chunk_id")
                 .agg(F.sum((1 + F.log("tf")) * F.col("idf") * F.col("wq")).alias("__dot")))
    return dots.join(index.norms, "chunk_id").select(
        "query_id", "chunk_id", (F.col("__dot") / F.col("norm")).alias("tfidf"))


# ---------------------------------------------------------------------------
# Hybrid score, top-k, roles, fallback, context
# ---------------------------------------------------------------------------

def pair_scores(bm25: DataFrame | None, tfidf: DataFrame) -> DataFrame:
    """(query_id, chunk_id, bm25, tfidf) over pairs matched by either scorer."""
    if bm25 is None:
        return tfidf.withColumn("bm25", F.lit(None).cast("double"))
    return (bm25.join(tfidf, ["query_id", "chunk_id"], "full_outer")
                .select("query_id", "chunk_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"),
                        F.coalesce("tfidf", F.lit(0.0)).alias("tfidf")))


def hybrid_score(pairs: DataFrame, group: list[str] = ("query_id",),
                 alpha: float = HYBRID_ALPHA, small_queries: bool | None = None) -> DataFrame:
    """Each score ÷ its maximum inside the group (max 0 → 1), then
    α·BM25 + (1 − α)·TF-IDF; TF-IDF alone when BM25 is absent.

    Unmatched chunks score 0 under both scorers, so the maxima over matched
    pairs floored at 0 equal the maxima over the whole candidate set.
    """
    group = list(group)
    mx = pairs.groupBy(*group).agg(F.max("bm25").alias("__mb"), F.max("tfidf").alias("__mt"))
    mx = _maybe_broadcast(mx, small_queries)

    def norm(c, m):
        m = F.greatest(F.col(m), F.lit(0.0))
        return F.col(c) / F.when(m == 0, F.lit(1.0)).otherwise(m)
    hyb = F.when(F.col("bm25").isNull(), norm("tfidf", "__mt")).otherwise(
        F.lit(alpha) * norm("bm25", "__mb") + F.lit(1 - alpha) * norm("tfidf", "__mt"))
    return pairs.join(mx, group).select(*pairs.columns, hyb.alias("score"))


def top_k(scored: DataFrame, k: int = TOP_K, group: list[str] = ("query_id",)) -> DataFrame:
    """Per group the k best chunks with score > 0, 4 decimals. Ties on the
    score (at 6 decimals) break by chunk_id."""
    w = Window.partitionBy(*group).orderBy(F.desc(F.round("score", 6)), F.asc("chunk_id"))
    return (scored.where(F.col("score") > 0)
                  .withColumn("rank", F.row_number().over(w).cast("bigint"))
                  .where(F.col("rank") <= k)
                  .withColumn("score", F.round("score", 4)))


class Retriever:
    """Retrieval over one chunk table (``chunk_id, text, source, tags``): a segmented index
    for the best k, written when first asked for; score tables of all pairs, which do not
    read it, only where they are asked for."""

    def __init__(self, chunks: DataFrame, index, use_bm25: bool = True, path: str | None = None):
        self.chunks, self._index, self.use_bm25, self.path = chunks, index, use_bm25, path

    @property
    def index(self):
        if self._index is None:
            from tablekit.operators.segments import SegmentedIndex
            from tablekit.session import scratch_path
            path = self.path or scratch_path(self.chunks.sparkSession, "index")
            self._index = SegmentedIndex.build(self.chunks, path, self.use_bm25)
        return self._index

    @classmethod
    def build(cls, chunks: DataFrame, use_bm25: bool = True, path: str | None = None) -> "Retriever":
        return cls(chunks, None, use_bm25, path)

    def pairs(self, queries: DataFrame) -> DataFrame:
        """Both scores of every (query, chunk) that share a term."""
        small = query_batch_fits_broadcast(queries)
        b = bm25_score(bm25_index(self.chunks), queries, small_queries=small) if self.use_bm25 else None
        return pair_scores(b, tfidf_cosine(tfidf_index(self.chunks), queries, small_queries=small))

    def hybrid(self, queries: DataFrame) -> DataFrame:
        return hybrid_score(self.pairs(queries), small_queries=query_batch_fits_broadcast(queries))

    def retrieve(self, queries: DataFrame, k: int = TOP_K, tag: str | None = None) -> DataFrame:
        """R8 (optionally inside one tag): query_id, rank, chunk_id, score."""
        from tablekit.operators.blockmax import top_k as block_top_k
        return block_top_k(self.index, queries, k, None if tag is None else [tag]).select(
            "query_id", "rank", "chunk_id", "score")

    def retrieve_for_roles(self, queries: DataFrame, role_tags: DataFrame,
                           k: int = TOP_K) -> DataFrame:
        """Per role, for each of its tags (in order) the top-k inside the tag;
        a text seen under an earlier tag keeps its first score; then the best k by
        rounded score (ties: tag order, then rank inside the tag).
        ``role_tags``: (role, tag, tag_ord), a small table (its tags are collected)."""
        from tablekit.operators.blockmax import top_k as block_top_k
        tags = [r["tag"] for r in role_tags.select("tag").distinct().orderBy("tag").collect()]
        per_tag = block_top_k(self.index, queries, k, tags)
        texts = self.chunks.select("chunk_id", F.sha2("text", 256).alias("__th"))
        cand = (per_tag.join(texts, "chunk_id")
                       .join(bounded_broadcast(role_tags), "tag"))
        firsts = (cand.groupBy("role", "query_id", "__th")
                      .agg(F.min_by(F.struct("chunk_id", "score", "tag_ord", "rank"),
                                    F.struct("tag_ord", "rank")).alias("f"))
                      .select("role", "query_id", "f.*"))
        w = Window.partitionBy("role", "query_id").orderBy(
            F.desc("score"), F.asc("tag_ord"), F.asc("rank"))
        return (firsts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
                      .select("role", "query_id", F.col("r").cast("bigint").alias("rank"),
                              "chunk_id", "score"))

    def retrieve_with_fallback(self, queries: DataFrame, role_tags: DataFrame,
                               k: int = TOP_K) -> DataFrame:
        """A (role, query) with no role result takes the unfiltered top-k."""
        by_role = self.retrieve_for_roles(queries, role_tags, k)
        glob = self.retrieve(queries, k)
        roles = role_tags.select("role").distinct()
        missing = (bounded_broadcast(roles).crossJoin(queries.select(F.col("query_id")))
                   .join(by_role.select("role", "query_id").distinct(), ["role", "query_id"], "left_anti"))
        return by_role.unionByName(missing.join(glob, "query_id").select(*by_role.columns))

    def context(self, results: DataFrame, key: list[str] = ("query_id",)) -> DataFrame:
        """The numbered ``[i] (source) text`` block per query."""
        key = list(key)
        j = results.join(self.chunks.select("chunk_id", "source", "text"), "chunk_id")
        line = F.format_string("[%d] (%s) %s", F.col("rank"), F.col("source"), F.col("text"))
        lines = (j.groupBy(*key)
                  .agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("ls")))
        body = F.array_join(F.transform("ls", lambda s: s["l"]), "\n")
        return lines.select(*key, F.concat(F.lit("--- Relevant knowledge ---\n"), body,
                                           F.lit("\n--- End of knowledge ---")).alias("context"))


# ---------------------------------------------------------------------------
# Corpus maintenance
# ---------------------------------------------------------------------------

def append_bm25_terms(old_terms: DataFrame, old_stats: DataFrame,
                      new_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Df and N are additive, so only the new chunks are tokenised; idf
    (with its corpus-wide mean) is recomputed on the term table."""
    new = bm25_index(new_chunks)
    dfs = (old_terms.select("term", "df").unionByName(
               new.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
           .groupBy("term").agg(F.sum("df").alias("df")))
    os_, ns = old_stats.alias("o"), new.stats.alias("n")
    stats = os_.crossJoin(ns).select(
        (F.col("o.n_docs") + F.col("n.n_docs")).alias("n_docs"),
        ((F.col("o.avgdl") * F.col("o.n_docs") + F.col("n.avgdl") * F.col("n.n_docs"))
         / (F.col("o.n_docs") + F.col("n.n_docs"))).alias("avgdl"))
    terms = bm25_terms_from_df(dfs.crossJoin(F.broadcast(stats.select("n_docs"))), F.col("n_docs"))
    return terms, stats


def append_chunks(chunks: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """The chunk table with the new chunks appended (ids continue after the max)."""
    base = chunks.agg(F.coalesce(F.max("chunk_id"), F.lit(-1)).alias("__base"))
    from tablekit.functions.joins import dense_index
    numbered = dense_index(new_chunks, ["source", "text"], "__i")
    return chunks.unionByName(
        numbered.crossJoin(F.broadcast(base))
                .select((F.col("__base") + 1 + F.col("__i")).alias("chunk_id"), "text", "source", "tags"))


def new_texts_only(chunks: DataFrame, batch: DataFrame) -> DataFrame:
    """Keep batch chunks whose text is not stored yet (duplicates inside
    the batch are kept). Anti-join on a 256-bit text digest plus the text."""
    known = chunks.select(F.sha2("text", 256).alias("__kh"), F.col("text").alias("__kt"))
    return (batch.withColumn("__th", F.sha2("text", 256))
                 .join(known, (F.col("__th") == F.col("__kh")) & (F.col("text") == F.col("__kt")),
                       "left_anti")
                 .drop("__th"))


def learn_from_results(chunks: DataFrame, batch: DataFrame) -> DataFrame:
    return append_chunks(chunks, new_texts_only(chunks, batch))


def corpus_size(chunks: DataFrame) -> DataFrame:
    """R14."""
    return chunks.agg(F.count(F.lit(1)).cast("bigint").alias("n_chunks"))
