"""Centroid clustering, importance resampling and URL filters against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.errors import PySparkException

from tablekit.llm import centroids, resample, urls

INF = float("inf")


def plain_clusters(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(own[j]) for x in zip(*own[j])] if j in own else m for j, m in enumerate(c)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], c


@pytest.mark.parametrize("k, dims, rounds", [(4, 3, 3), (16, 5, 2), (2, 64, 0)])
def test_clusters_against_plain(spark, k, dims, rounds):
    rng = random.Random(k)
    rows = [(i, [rng.choice([rng.uniform(-3, 3), 0.5, -7.25]) for _ in range(dims)]) for i in range(120)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (300, None), (301, [1.0]), (302, []), (303, [None] * dims), (304, [float("nan")] * dims), (305, [INF] + [0.0] * (dims - 1))]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, dots int").repartition(5)
    found = centroids.cluster(df, k=k, rounds=rounds, dims=dims, scale=8, seed="s")
    want, c = plain_clusters(rows, k, rounds, dims, 8, "s")
    assert found.centroids == c
    assert sorted(((r.id, r.cluster, r.distance) for r in found.rows.collect()), key=str) == sorted(want, key=str)
    for r in found.rows.collect():  # the persisted matrix is exact
        assert r.dots == [sum(a * b for a, b in zip(r.v, m)) for m in c]
    out = centroids.with_totals(found).collect()
    assert {r.inertia for r in out} == {sum(d for _, _, d in want)}
    each = Counter()
    for _, j, d in want:
        each[j] += d
    assert all(r.cluster_inertia == each[r.cluster] and r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest() for r in out)


def test_clusters_of_few_none_and_too_large(spark):
    schema = "vec_id long, embedding array<float>"
    few = centroids.with_totals(centroids.cluster(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], schema), dims=2)).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in few] == [(0, 0, 0)] * 2
    for rows in ([], [(1, None)]):
        none = centroids.with_totals(centroids.cluster(spark.createDataFrame(rows, schema), dims=2))
        assert none.count() == 0 and none.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(PySparkException, match="would not fit"):
        centroids.cluster(spark.createDataFrame([(1, [3e30, 0.0])], schema), dims=2).rows.collect()


def test_checksums_compose():
    rng = random.Random(1)
    words = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 2, 7, 300]))) for _ in range(50)]
    import numpy as np

    crc, length = np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words])
    for n in (1, 2, 3, 5):
        got, at = resample.run_crcs(crc, length, np.full(50, 49), n)
        assert list(at) == list(range(51 - n))
        assert list(got) == [zlib.crc32(b" ".join(words[i : i + n])) for i in at]


def plain_features(text, max_n, buckets):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    runs = [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(r.encode()) % buckets for r in runs]


def plain_resample(docs, target, max_n, buckets, percent, min_words, seed):
    found = [(i, *plain_features(t, max_n, buckets)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in plain_features(x, max_n, buckets)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    rank = [(r[0], r[2], r[3], r[4], k + 1 if k < len(able) * percent // 100 else None) for k, r in enumerate(able)]
    return rank + [(r[0], r[2], r[3], r[4], None) for r in rows if r[1] < min_words]


ODD = [None, "", " \n-- ", "A", "Straße ÉTÉ été naïve 東京 x-y_z 3.14", "\x00a\x7fb`c{d@e", "b" * 70_000, "İı K ſ"]


@pytest.mark.parametrize("max_n, block", [(1, 1 << 22), (3, 200)])
def test_resample_against_plain(spark, monkeypatch, max_n, block):
    monkeypatch.setattr(resample, "BLOCK", block)
    rng = random.Random(3)
    vocab = [f"Wort{i}" for i in range(60)] + ["über", "é", "42"]
    texts = ODD + [" ".join(rng.choices(vocab, k=rng.randrange(60))) for _ in range(150)] + ["long story, " * 3000]
    docs = list(enumerate(texts)) + [(20, texts[20]), (20, texts[20]), (21, texts[30]), (None, texts[31])]
    target = [" ".join(rng.choices(vocab[:20], k=30)) for _ in range(9)] + [None, "", "straße"]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id int, text string, rank int, id string").repartition(4)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(df, wanted, max_n=max_n, buckets=97, percent=25, min_words=10)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_resample(docs, target, max_n, 97, 25, 10, "2024"), key=str)


def test_resample_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert resample.resample(empty, empty).count() == 0
    one = resample.resample(spark.createDataFrame([(1, "a b")], empty.schema), empty, min_words=1, percent=100).collect()
    assert [(r.n_features, r["rank"]) for r in one] == [(2, 1)]


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "spam.org", "/ads/")]


def test_hosts_paths_and_rules(spark):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme/x": ("", "", None, "allow"),
        "http://A.Example.NET/en/X?q#f": ("a.example.net", "/en/X", "example.net/en/", "allow"), "http://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "x://net": ("net", "", None, "allow"), "x://net?/": ("net", "", None, "allow"), "x://aexample.net/en/": ("aexample.net", "/en/", "net/", "block"),
        "http://b.org/://c.net/": ("b.org", "/://c.net/", None, "allow"), "http://spam.org/ads/1#x?y": ("spam.org", "/ads/1", "spam.org/ads/", "block"),
        "http://ÄB.org/é\n/z": ("Äb.org", "/é\n/z", None, "allow"), "http://h.org/" + "a" * 200_000: ("h.org", "/" + "a" * 200_000, None, "allow"),
    }
    df = spark.createDataFrame([(u, "v", 1) for u in cases], "url string, verdict string, row int")
    out = urls.judge(df, RULES)
    assert out.columns == ["url", "row", "host", "path", "rule", "verdict"]
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in out.collect()} == cases
    assert urls.judge(df.limit(0), RULES).count() == 0


def test_templates_reject_by_purity(spark):
    """Unlabelled urls of a mostly blocked template go; neither a large unlabelled branch
    beside it nor mixed templates do."""
    rows = [f"http://spam.org/ads/{i}" for i in range(60)] + [f"http://spam.org/ad-s/{i}" for i in range(40)]
    rows += [f"http://spam.org/ads/item-{i}.html" for i in range(30)] + [f"http://spam.org/news/story{i}" for i in range(300)]
    rules = [("block", "spam.org", "/ads/"), ("block", "spam.org", "/news/story7"), ("allow", "spam.org", "/news/story1"), ("block", "spam.org", "/x/y")]
    rows += [f"http://spam.org/x/{'y' if i % 10 else 'Y'}{i}" for i in range(60)] + [f"http://fine.org/{'xy'[i % 2]}/Y{i}" for i in range(50)]
    got = urls.judge(spark.createDataFrame([(u,) for u in rows], "url string"), rules, min_share=0.1).collect()
    verdict = {r.url: r.verdict for r in got}
    assert len(got) == len(rows)
    assert all(v == "allow" for u, v in verdict.items() if "fine.org" in u or "/ad-s/" in u)
    assert all(verdict[u] == "block" for u in rows if "/x/Y" in u and "spam.org" in u)  # 6 of 60 unlabelled
    assert verdict["http://spam.org/news/story2"] == "allow" and verdict["http://spam.org/news/story70"] == "block"
    tree = {(r.host, r.masked): r for r in urls.learn(spark.createDataFrame([(r.host, r.path, r.verdict if r.rule else None) for r in got], "host string, path string, verdict string"), min_share=0.1).collect()}
    assert tree["fine.org", "/x/*"].template == tree["fine.org", "/y/*"].template == "/{}/*"
    assert tree["spam.org", "/x/*"].template == "/x/*" and tree["spam.org", "/ads/*"].template.startswith("/ads/")
    assert tree["spam.org", "/x/*"].rejected and not tree["spam.org", "/news/*"].rejected


def test_slugs_are_wildcards_and_depth_is_cut(spark):
    rng = random.Random(2)
    slug = lambda: "".join(rng.choices("abcdefgh", k=8))
    rows = [("h", f"/blog/{slug()}/comments/new", None) for _ in range(80)] + [("h", "/about", None)] * 30 + [("h", "", "block")]
    tree = urls.learn(spark.createDataFrame(rows, "host string, path string, verdict string"))
    assert {r.template for r in tree.collect()} == {"/blog/*/comments/**", "/about", ""}
    assert {(r.n, r.n_block) for r in tree.where("template = ''").collect()} == {(1, 1)}


def test_verdicts_learn_from_whole_paths(spark):
    """Branches below the third segment differ: only the blocked one is rejected, also where
    a host has one deep path; a shallow host's tree does not depend on it."""
    base = "http://deep.org/a/b/c"
    rows = [f"{base}/ads/x/{i}" for i in range(60)] + [f"{base}/news/x/{i}" for i in range(60)]
    rows += ["http://deep.org/" + "/".join("stuvwxyz" * 3), "http://flat.org/p/q"]
    rules = [("block", "deep.org", "/a/b/c/ads/x/1"), ("block", "deep.org", "/a/b/c/ads/x/2"), ("block", "deep.org", "/a/b/c/ads/x/3"), ("block", "deep.org", "/a/b/c/ads/x/4")]
    got = {r.url: r.verdict for r in urls.judge(spark.createDataFrame([(u,) for u in rows], "url string"), rules).collect()}
    assert len(got) == len(rows)
    assert all(got[u] == ("block" if "/ads/" in u else "allow") for u in rows)
    parsed = spark.createDataFrame([("h", f"/a/b/c/{x}/{'k' * i}", None) for x in ("d", "e1") for i in range(1, 30)] + [("h", "/a/b/c/d/e/f/g", None)] * 5, "host string, path string, verdict string")
    tree = {r.masked: r.template for r in urls.learn(parsed, levels=None).collect()}
    assert len(tree) == 59 and tree["/a/b/c/d/e/f/g"].count("/") == 7 and "**" not in "".join(tree.values())
