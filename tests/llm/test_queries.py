"""The registered queries against brute force over whole small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from brindle.llm import bpe, near_dedup, queries, sharding
from brindle.llm.textvec import mix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return {r["doc_id"]: r for r in rows}


def result(spark, name):
    return [r.asDict() for r in queries.queries()[name](spark, SF).collect()]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_classes(texts):
    """Smallest id of each class of texts linked by a Jaccard similarity of 0.8 or more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holds = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holds[x].add(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holds[x] if j < i).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def test_near_dedup(spark, docs):
    want = brute_classes({i: r["text"] for i, r in docs.items()})
    got = {r["doc_id"]: r["class_id"] for r in result(spark, "op1_near_dedup")}
    assert got == want


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = {}
    for kind, pattern in BASE.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d or "0"), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out[kind].append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, docs):
    got = {r["doc_id"]: r for r in result(spark, "op2_pii")}
    assert len(got) == len(docs)
    for i, r in docs.items():
        want = base_spans(r["text"])
        assert {k: got[i][f"n_{k}"] for k in BASE} == {k: len(v) for k, v in want.items()}
        flat = [s for v in want.values() for s in v]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(flat).encode()).hexdigest()
        assert [s for s in got[i]["spans"].split(",") if s][: len(flat)] == flat


def test_exact_dedup(spark, docs):
    groups = defaultdict(list)
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for i, r in docs.items()}
    for i, t in norm.items():
        groups[t].append(i)
    want = {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in result(spark, "op3_exact_dedup")}
    assert got == want


def test_bpe(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    got = {r["doc_id"]: r for r in result(spark, "op6_bpe")}
    assert len(got) == len(docs)
    for i, r in docs.items():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, docs):
    got = result(spark, "op9_sharding")
    assert len(got) == len(docs)
    slots = defaultdict(list)
    for r in got:
        text = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 1, zlib.crc32(text), "key")
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 8), jump(r["doc_id"], 9))
        assert r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append((r["slot"], r["doc_id"]))
    for own in slots.values():
        assert [s for s, _ in sorted(own)] == list(range(len(own)))
        assert [d for _, d in sorted(own)] == sorted(d for _, d in own)


def brute_leaks(texts, items, window=10):
    holders = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if n else ():
            holders[tuple(w[s : s + n])].add(item)
    sizes = {len(k) for k in holders}
    out = {}
    for i, text in texts.items():
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if items_here := holders.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= items_here
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out[i] = (len(w), len(hit), len([x for x in found if x is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


def test_decontaminate(spark, docs):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    want = brute_leaks({i: r["text"] for i, r in docs.items()}, items)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in result(spark, "op10_decontaminate")}
    assert got == want
    assert any(r[4] for r in got.values())


def test_language(spark, docs):
    got = result(spark, "op7_language")
    assert {r["doc_id"] for r in got} == set(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in out) >= 0.95 * len(out)


@pytest.mark.parametrize(("name", "column", "modulus", "remainder"), [("op4_quality", "quality", 3, 1), ("op8_toxicity", "toxic", 5, 0)])
def test_classifiers(spark, name, column, modulus, remainder):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r[column] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    got = [r.asDict() for r in queries.queries()[name](spark, sf).collect()]
    assert len(got) == pq.read_table(f"{sf}/documents.parquet").num_rows
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder)
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.5)
    out = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in out) >= 0.9 * len(out)


def test_jump_moves_only_into_the_new_shard():
    import numpy as np

    keys = np.arange(-500, 5000)
    for n in (1, 2, 8, 100):
        before, after = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert ((before == after) | (after == n)).all()
        assert before.min() >= 0 and before.max() < n


def test_prob_min_hash_estimates_jaccard():
    import numpy as np

    a, b = np.arange(0, 900, dtype=np.uint64), np.arange(100, 1000, dtype=np.uint64)
    doc = np.repeat([0, 1], 900)
    item = mix(np.concatenate([a, b]))
    kept = near_dedup.prob_min_hash(doc, item, np.ones(1800), 2, 4096)
    assert abs((kept[0] == kept[1]).mean() - 0.8) < 0.03


def test_bpe_matches_the_library_on_odd_texts():
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    tokenizer, own = tokenizers.Tokenizer.from_file(path), bpe.Codec(bpe.load_vocabulary(path))
    texts = ["", " ", "  a", "a  b", "a \n b", "x<|endoftext|> y", "It's we'll 123 45", "a\x1cb c\x85d", "日本語 テキスト", "🙂👍🏽 x", "aaaa" * 2000, "ab" * 60, "don’t ’s\t\t x", "İ ß ǆ"]
    for text, got in zip(texts, own.digests(texts), strict=True):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert got[0] == len(ids)
        assert own.decode(ids).decode() == tokenizer.decode(ids, skip_special_tokens=False)
    many = [bytes([97 + i % 26, 98 + i % 7]) * (1 + i % 9) for i in range(600)]
    assert own.merge_many(many) == [own.merge(w) for w in many]
