"""Queries over whole tables, where a cut would lose rows."""

import duckdb
import pyarrow.parquet as pq

import __spark_entry__
from brindle.plans.registry import ORACLES

SF = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()


def answer(sql, *tables):
    db = duckdb.connect()
    for name in tables:
        db.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return db.execute(sql).fetchall()


def test_weighted_interleave(spark):
    got = sorted((r["place"], r["doc_id"], r["lang"]) for r in QUERIES["weighted_interleave"](spark, SF).collect())
    sql = ORACLES["weighted_interleave"]
    assert got == sorted((place, doc_id, lang) for doc_id, lang, place in answer(sql, "documents"))
    assert len(got) == pq.read_metadata(f"{SF}/documents.parquet").num_rows


def test_plateau_controller(spark):
    got = sorted(tuple(r) for r in QUERIES["plateau_controller"](spark, SF).select("event_type", "i", "loss", "cap", "act").collect())
    assert got == sorted(answer(ORACLES["plateau_controller"], "events"))
    assert len(got) == pq.read_metadata(f"{SF}/events.parquet").num_rows


def test_contrast_pairs(spark):
    seen = {r["item_id"]: len(r["text"]) % 2 for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
    want = sorted((i // 2, (p, seen[i + 1]) == (0, 1), (p, seen[i + 1]) == (1, 0), p != seen[i + 1]) for i, p in seen.items() if i % 2 == 0 and i + 1 in seen)
    assert sorted(tuple(r) for r in QUERIES["contrast_pairs"](spark, SF).select("pair", "both_right", "both_wrong", "switched").collect()) == want
    assert 2 * len(want) == len(seen)


def test_rare_family_coverage(spark):
    import re

    got, pools = {}, {}
    for r in QUERIES["rare_family_coverage"](spark, SF).collect():
        got.setdefault(r["lang"], []).append((r["turn"], r["doc_id"]))
    for r in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        pools.setdefault(r["lang"], {})[r["doc_id"]] = {len(w) for w in re.sub("[^a-z0-9]+", " ", (r["text"] or "").lower()).split()}
    assert set(got) == set(pools)
    for lang, pool in pools.items():
        seen, picked = {}, []
        for _ in range(min(10, len(pool))):
            best = min((i for i in pool if i not in picked), key=lambda i: (sum(seen.get(f, 0) for f in pool[i]) / max(1, len(pool[i])), i))
            picked.append(best)
            for f in pool[best]:
                seen[f] = seen.get(f, 0) + 1
        assert [i for _, i in sorted(got[lang])] == picked


def test_similar_documents(spark):
    import hashlib
    import re

    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    sets = {i: set(re.sub("[^a-z0-9]+", " ", t.lower()).split()) for i, t in texts.items()}
    near = {(i, j) for i in sets for j in sets if i < j and sets[i] and 5 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])}
    assert near
    got = QUERIES["document_jaccard_pairs"](spark, SF).collect()
    assert sorted((r["left_id"], r["right_id"], r["common"], r["jaccard"]) for r in got) == sorted((i, j, len(sets[i] & sets[j]), round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 6)) for i, j in near)
    root = {i: i for i in sets}
    for _ in sets:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    assert {r["doc_id"]: r["root"] for r in QUERIES["dup_components"](spark, SF).collect()} == root
    kept = []
    for i in sorted(sets, key=lambda i: (hashlib.sha256(f"seed:{i}".encode()).hexdigest(), i)):
        if not any((min(i, j), max(i, j)) in near for j in kept):
            kept.append(i)
    assert sorted(r["doc_id"] for r in QUERIES["greedy_keep_first"](spark, SF).collect()) == sorted(kept)
