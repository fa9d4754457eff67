"""Jaccard join, small-world graphs, components and language ID against brute force."""

import random
import re

import numpy as np
import pytest

from tablekit.llm import hnsw, jaccard, langid
from tablekit.llm.components import components
from tablekit.llm.queries import QUERIES


def classes(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_jaccard(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * (n := len(sets[a] & sets[b])) >= 75 * len(sets[a] | sets[b]) and n]
    comp = classes(ids, links)
    return {(i, len(sets[i]), comp[i]) for i in ids}


def copies(seed, groups, most, words=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = [rng.choice(vocab) for _ in range(14)]
    out = []
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(words + rng.randrange(60))]
        for _ in range(rng.randrange(1, most)):
            w = [rng.choice(vocab) if rng.random() < rng.choice([0, 0.01, 0.03, 0.05]) else x for x in base]
            w = w[: len(w) - rng.randrange(12)]
            out.append(" ".join(common + w if rng.random() < 0.7 else w))
    return out


ODD = [None, "", " \n ", "one", "ONE", "one two three four", "One  two\tthree\nfour", "one two three four five", "é É é É é", "É É é É é", "long " * 30000, "long " * 29000, "x" * 3_000_000, ("word " * 3 + "y" * 100 + " ") * 9000]


@pytest.mark.parametrize("small_tile, tile_block", [(64, 1024), (2, 7)])
def test_jaccard_against_brute_force(spark, small_tile, tile_block):
    docs = list(enumerate(ODD + copies(1, 12, 25) + copies(2, 3, 60)))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, node string, n int").repartition(5)
    got = {tuple(r) for r in jaccard.near_dups(df, small_tile=small_tile, tile_block=tile_block).collect()}
    assert got == brute_jaccard(docs)


def test_jaccard_dealt_tiles_and_large_groups(spark, monkeypatch):
    """Groups of 64 and 1,000 near copies, whose tiles are dealt into parts."""
    monkeypatch.setattr(jaccard, "HOT_SETS", 8)
    monkeypatch.setattr(jaccard, "TILE_PART", 40)
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(900)]
    texts = []
    for size in (64, 1000, 3, 2):
        base = [rng.choice(vocab) for _ in range(70)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    docs = list(enumerate(texts + copies(7, 4, 9)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {tuple(r) for r in jaccard.near_dups(df, tile_block=100).collect()}
    assert got == brute_jaccard(docs)


def test_jaccard_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "alone here"), (9, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.near_dups(df).collect()), key=str)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 1, None), (9, 0, 9)], key=str)
    assert jaccard.near_dups(df.limit(0)).count() == 0


def test_jaccard_query(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert {tuple(r) for r in QUERIES["op5_jaccard"](spark, sf_small).collect()} == brute_jaccard(docs)


def test_signatures_never_reject_a_link():
    rng = random.Random(4)
    sets = [jaccard.shingles(jaccard.word_hashes(t.encode())[0]) for t in copies(6, 6, 12)]
    for x in rng.sample(sets, min(30, len(sets))):
        for y in sets:
            both = len(np.intersect1d(x, y))
            if 100 * both >= 75 * (len(x) + len(y) - both):
                a, b = (np.frombuffer(jaccard.signature(z), np.uint64)[None] for z in (x, y))
                assert jaccard.may_overlap(a, b, np.array([len(x)]), np.array([len(y)])).all()


@pytest.mark.parametrize("at_once", [400_000, 300])
def test_components_of_chains_stars_and_loops(spark, at_once):
    rng = random.Random(8)
    n = list(range(0, 9000, 3))
    rng.shuffle(n)
    links = list(zip(n[:1500], n[1:1501])) + [(n[1600], x) for x in n[1601:2600]] + [(n[2700], n[2701]), (n[2701], n[2700]), (n[2700], n[2700])]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long").repartition(7), at_once=at_once).collect()}
    want = classes(set(got), links)
    groups = {}
    for x, c in got.items():
        groups.setdefault(c, set()).add(want[x])
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == len(set(want.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 6, dim))
    out = [base[rng.integers(len(base))] * rng.uniform(0.1, 9) + rng.normal(size=dim) * rng.choice([0, 0.02, 0.1]) for _ in range(n)]
    return [x.astype(np.float32).tolist() for x in out]


def brute_cosine(rows):
    ok = {i: np.array(v, float) for i, (k, v, l) in enumerate(rows) if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    near = [(a, b) for a in ok for b in ok if a < b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.98]
    degree = dict.fromkeys(range(len(rows)), 0)
    for a, b in near:
        degree[a] += 1
        degree[b] += 1
    comp = classes(range(len(rows)), near)
    ids = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            ids[comp[i]] = min(ids.get(comp[i], k), k)
    return sorted(((k, degree[i], ids.get(comp[i])) for i, (k, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("shard_rows, block_rows", [(8192, 2048), (60, 40)])
def test_graphs_against_brute_force(spark, shard_rows, block_rows):
    rows = [(i, v, i % 3 if i % 17 else None) for i, v in enumerate(vectors(3, 500))]
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 16, 1), (603, [float("nan")] * 16, 1), (604, [None] * 16, 1), (605, [float("inf")] * 16, 1), (606, [1.0, 2.0], 1), (607, [2.0, 4.0], 1), (None, [2.0, 4.0], 1), (None, [5.0, -4.0], 1), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "vec_id long, embedding array<float>, label int, weight double").repartition(3)
    got = hnsw.near_dups(df, shard_rows=shard_rows, block_rows=block_rows).collect()
    want = brute_cosine(rows)
    assert sorted((r.vec_id, r.component_id) if r.vec_id is not None else (None, r.component_id) for r in got if r.vec_id in (606, 607)) == [(606, 606), (607, 606)]
    found, all_ = sum(r.n_links for r in got), sum(w[1] for w in want)
    assert 0.98 * all_ <= found <= all_
    if found == all_:
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_copies_of_one_vector_and_empty(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0], 1) for i in range(300)], "vec_id long, embedding array<float>, label int")
    assert {(r.n_links, r.component_id) for r in hnsw.near_dups(df).collect()} == {(299, 0)}
    assert hnsw.near_dups(df.limit(0)).count() == 0


def test_embeddings_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op7_embeddings"](spark, sf).collect()
    all_ = sum(w[1] for w in brute_cosine(rows))
    assert len(got) == len(rows) and 0.9 * all_ <= sum(r.n_links for r in got) <= all_


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_langid"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) > 100
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_texts(spark):
    train = [(i, t, lang, "x") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der Hund und die Katze", "de"), ("東京の猫と犬", "ja"), ("no label", None), (None, "en")] * 3)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string, score string")
    model = langid.fit(df)
    assert model.langs == ["de", "en", "fr", "ja"]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the dog"), (5, "le chien et le chat " * 200_000), (6, "犬と猫"), (None, "THE CAT")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, 6, None)] == ["und", "und", "und", "en", "fr", "ja", "en"]
    assert got[1][1] == got[2][1] == got[3][1] == 0
    nothing = langid.fit(df.where("lang = 'xx'"))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.predict(odd.limit(0), model).count() == 0


def test_features_match_kernels_by_definition():
    texts = ["the cat", "the hat", "le chat"]
    letters = np.array(sorted({ord(c) for t in texts for c in t if c.isalpha()}), np.int64)
    m = langid.Model(["a"], letters, None, None)
    table, size = m.table(), len(letters) + 1
    m.known = np.unique(np.concatenate([c for t in texts for c in langid._codes(langid._symbols(t, table), size)]))
    m.weights = np.zeros((len(m.known) + 1, 1))
    p = langid.presence(texts, m, table)
    grams = [{f" {t} "[i : i + n] for n in (1, 2, 3) for i in range(len(t) + 3 - n)} for t in texts]
    assert (p @ p.T).tolist() == [[len(x & y) for y in grams] for x in grams]


def _rare_links(groups, size, seed=1):
    """Unit vectors of dense groups, isolated ones, and one near copy of 300 of these; the
    rows of the near copies come second."""
    r = np.random.default_rng(seed)
    alone = r.normal(size=(400, 32))
    near = [c + r.normal(size=(size, 32)) * 0.05 for c in r.normal(size=(groups, 32))]
    x = np.concatenate([*near, alone, alone[:300] + r.normal(size=(300, 32)) * 0.03])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    order = r.permutation(len(x))
    return x[order], np.nonzero(order >= len(x) - 300)[0]


@pytest.mark.parametrize("groups,size", [(12, 250), (2, 1500)])
def test_rare_links_beside_dense_groups(groups, size):
    x, rare = _rare_links(groups, size)
    q = np.concatenate([rare, np.setdiff1d(np.arange(len(x)), rare)[:1748]])
    true = x[q] @ x.T >= 0.98
    got = np.zeros_like(true)
    a, b = hnsw.search(hnsw.Graph(x), x[q], 0.98, 0.98, q)
    assert len(set(zip(a.tolist(), b.tolist()))) == len(a)
    got[a, b] = True
    true[np.arange(len(q)), q] = got[np.arange(len(q)), q] = False
    assert not (got & ~true).any()
    for rows in (slice(0, 300), slice(300, None)):
        assert got[rows].sum() >= 0.98 * true[rows].sum()


def test_audit_sees_what_a_poor_graph_misses():
    x, rare = _rare_links(2, 400)
    graph = hnsw.Graph(x)
    plain = graph.within

    def poor(q, least, width, reach):
        """Every query's own node and the links of dense groups, never the rare ones."""
        a, b = plain(q, least, width, reach)
        keep = np.bincount(a, minlength=len(q))[a] > 8
        return a[keep], b[keep]

    graph.within = poor
    a, b = hnsw.search(graph, x, 0.98, 0.98, np.arange(len(x)))
    assert len(a) == (x @ x.T >= 0.98).sum()
