"""Ball k-means, licence scans and WAND against brute force, at their edges too."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from brindle.llm import clustering, licenses, ranking, shared

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def plain_kmeans(vectors, k, rounds, dims):
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))[:k]
    centers = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in rows]
        for j in range(len(centers)):
            mine = [v for (_, v), c in zip(rows, own, strict=True) if c == j]
            if mine:
                centers[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in rows], centers


def vectors_of(kind, seed):
    r = random.Random(seed)
    if kind == "clumps":  # far apart: stable cores, settled balls
        return [(i, [r.gauss(10 * (i % 7) * (j == i % 4), 0.02) for j in range(4)]) for i in range(400)]
    if kind == "grid":  # many equal distances
        return [(i, [r.randrange(3) / 4 for _ in range(4)]) for i in range(400)]
    wide = [(i, [r.uniform(-2e5, 2e5) for _ in range(4)]) for i in range(200)]
    odd = [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0, None, 1.0, 1.0]), (904, [1.0, float("nan"), 1.0, 1.0]), (905, [float("inf")] * 4), (None, [1.0] * 4), (None, [2.0] * 4), (7, [3.0] * 4), (7, [3.0] * 4)]
    return wide + odd


@pytest.mark.parametrize("kind", ["clumps", "grid", "odd"])
def test_clusters(spark, kind):
    data = vectors_of(kind, 3)
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id long, embedding array<double>, cluster int, v int").repartition(3)
    rows, balls = clustering.cluster(frame, k=9, dims=4)
    want, centers = plain_kmeans(data, 9, 5, 4)
    order = lambda x: sorted(x, key=repr)
    assert order((r["vec_id"], r["cluster"], r["distance"]) for r in rows.collect()) == order(want)
    assert [r["centroid"] for r in sorted(balls.collect(), key=lambda r: r["cluster"])] == centers
    assert sum(r["n"] for r in balls.collect()) == len(want)


def test_fewer_vectors_than_clusters_and_none(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<float>")
    got = clustering.report(frame, k=40, dims=2).collect()
    assert sorted((r["vec_id"], r["distance"], r["inertia"]) for r in got) == [(1, 0, 0), (2, 0, 0)]
    assert clustering.report(frame.filter("false"), dims=2).collect() == []


def test_components_beyond_the_limit(spark):
    frame = spark.createDataFrame([(i, [x] * 64) for i, x in enumerate([1e38, -1e38, 0.0])], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["distance"] for r in clustering.report(frame, k=1).collect()}
    assert len(got) == 3 and max(got.values()) < 1 << 61 and clustering.limit(64) == 1 << 26


def test_balls_compare_neighbours_only():
    """A clump's members are never compared with centroids beyond twice its radius."""
    r = np.random.default_rng(1)
    centers = np.array([[0, 0], [1000, 0], [0, 1000], [40, 0]])
    rows = np.concatenate([c + r.integers(-30, 31, (200, 2)) for c in centers])
    own, best = clustering.assign(rows, np.full(len(rows), -1), np.zeros(len(rows), np.int64), clustering.Balls(centers))
    radius = np.array([best[own == i].max() ** 0.5 for i in range(4)])
    balls = clustering.around(centers, radius, np.array([True, False, False, False]))
    assert [x.tolist() for x in balls.near] == [[3], [], [], [0]] and balls.settled.tolist() == [False, True, True, False]
    again, same = clustering.assign(rows, own, best, balls)
    assert (again == own).all() and (same == best).all()


def plain_notices(texts, known):
    n, df = len(texts), Counter()
    for t in texts:
        df.update(set(words(t)))
    weight = lambda w: 1 + math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
    out = []
    for text in texts:
        own, found = words(text), []
        for t in known:
            for start in range(-len(t.words), len(own)):
                here = [0 <= start + j < len(own) and own[start + j] == w for j, w in enumerate(t.words)]
                share = sum(weight(w) for w, hit in zip(t.words, here, strict=True) if hit) / sum(map(weight, t.words))
                if all(here[j] for j in t.keys) and share >= licenses.SHARE:
                    found.append((t.label, start, start + len(t.words), round(share, 12), t.base))
        out.append((len(own), sorted(found)))
    return out


def notice_texts():
    r = random.Random(4)
    known = [t for _, t, _ in licenses.NOTICES + licenses.BASE]
    spoilt = [" ".join(w if r.random() > 0.1 else r.choice(["x", "", "the"]) for w in t.split()) for t in known for _ in range(4)]
    cut = [" ".join(t.split()[k:]) for t in known for k in (1, 2, 5)]
    return [None, "", "...", "CC-BY 4.0", "cc by cc by cc BY", "All rights\nreserved. all rights reserved", "General public  license", *known, *spoilt, *cut, " ".join(known) * 20, "w " * 50_000 + known[2], "İ cc by"]


def test_notices(spark):
    texts = notice_texts()
    frame = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(texts)] + [(3, "cc by", None, 1)], "doc_id long, text string, labels string, n_words int").repartition(3)
    want = plain_notices([*texts, "cc by"], licenses.templates())
    found = licenses.scan(frame)
    got = [(r["doc_id"], r["n_words"], sorted((x["label"], x["start"], x["stop"], round(x["share"], 12), x["base"]) for x in r["notices"])) for r in found.collect()]
    assert sorted(got) == sorted((i, *w) for i, w in zip([*range(len(texts)), 3], want, strict=True))
    for r in licenses.digest(found).filter("doc_id > 3").collect():
        n, notices = want[r["doc_id"]]
        base = [x for x in notices if x[4]]
        assert (r["n_words"], r["n_base"]) == (n, len(base)) and r["labels"] == ",".join(sorted({x[0] for x in notices}))
        assert (r["first_word"], r["last_word"]) == ((min(x[1] for x in base), max(x[1] for x in base)) if base else (None, None))
    assert licenses.scan(frame.filter("false")).collect() == []


def plain_ranking(docs, items, k=10):
    bags = [(i, words(t)) for i, t in docs]
    n, total = sum(1 for _, w in bags if w), sum(len(w) for _, w in bags)
    df = Counter(x for _, w in bags for x in set(w))
    counts = [(i, len(w), Counter(w)) for i, w in bags]
    out = []
    for item, text in items:
        scored = []
        for i, size, tf in counts:
            m = 25 + 75 * size * n // total if total else 25
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in words(text) if tf[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return out


def search_tables():
    r = random.Random(6)
    vocabulary = [f"t{int(r.paretovariate(0.7))}" for _ in range(2000)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 80)))) for i in range(500)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(7, docs[8][1]), (None, docs[7][1]), (None, docs[9][1]), (600, None), (601, ""), (602, "?"), (603, "t1 " * 30_000 + "t2")]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 30)))) for i in range(30)]
    return docs, items + [(3, docs[7][1]), (3, docs[7][1]), (None, docs[8][1]), (40, None), (41, ""), (42, "unknown zzz"), (43, "T1 t1 T1, t2!")]


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 2000}, {"block_chars": 400, "shard_bytes": 10_000}])
def test_ranking(spark, options):
    docs, items = search_tables()
    random.Random(1).shuffle(docs)
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, rank int").repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, number int")
    got = ranking.rank(frame, asked, **options).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, plain_ranking(docs, items)))


def test_ranking_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranking.rank(docs.filter("false"), items).collect() == []
    assert ranking.rank(docs, items.filter("false")).collect() == []
    assert ranking.rank(docs, items).count() == 1


def test_wand_skips_documents():
    """Documents that can't beat the heap aren't scored, and the heap is right."""
    r = random.Random(2)
    docs = [(i, " ".join(f"t{int(r.paretovariate(0.5))}" for _ in range(40))) for i in range(3000)]
    texts = [docs[i][1] for i in range(0, 3000, 300)]
    queries, shard = ranking.Queries(texts), ranking.Shard()
    raw, at = ranking.utf8(ranking.pa.array([t for _, t in docs], ranking.pa.large_string()))
    for first, last, part, offsets in ranking.slices(raw, at):
        shard.add([i for i, _ in docs[first:last]], ranking.Words(part, offsets), queries.vocabulary)
    df = np.bincount(np.concatenate(shard.term), minlength=len(queries.vocabulary))
    corpus = ranking.Corpus(3000, 3000 * 40, np.array([math.floor(1000 * math.log(6002 / (2 * d + 1))) for d in df]))
    heaps = ranking.Heaps(len(texts), 10)
    scored = ranking.wand(ranking.Postings(shard, corpus), queries, heaps)
    assert scored < 0.5 * len(docs) * len(texts)
    want = plain_ranking(docs, enumerate(texts))
    assert sorted((q, -neg, s) for q, heap in enumerate(heaps.rows) for s, neg, _ in heap) == sorted((q, i, s) for q, _, i, s in want)


def test_stored_tables_can_be_deleted(spark, tmp_path):
    shared.clean(spark)
    shared.materialize(spark.range(3), "x")
    shared.materialize(spark.range(3), "y")
    assert shared.clean(spark) == 2 and shared.clean(spark) == 0
