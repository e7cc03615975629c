"""Operators against plain arithmetic: vectors, double sums, ratios, borders of methods."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from brindle.llm import bpe, decontaminate, exact_dedup, language, near_dedup, pii, quality, queries, shared, textvec, toxicity
from tests.llm.test_edges import prose
from tests.llm.test_queries import SF, base_spans, brute_classes, brute_leaks

MASK = (1 << 64) - 1


def mixed(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
    return x ^ x >> 31


class Profiles:
    """Language profiles, run by run."""

    def __init__(self, dimensions=language.DIMENSIONS):
        self.dimensions, self.letters, self.runs = dimensions, {}, {}

    def letter(self, c):
        if c not in self.letters:
            point, signs = 0 if c == " " else ord(c), []
            for i in range(-(-self.dimensions // 64)):
                z = mixed(mixed((point * 0x9E3779B97F4A7C15 + i * 0xC2B2AE3D27D4EB4F) & MASK))
                signs += [2 * (byte >> k & 1) - 1 for byte in z.to_bytes(8, "little") for k in range(7, -1, -1)]
            self.letters[c] = np.array(signs[: self.dimensions])
        return self.letters[c]

    def run(self, r):
        if r not in self.runs:
            a, b, c = map(self.letter, r)
            self.runs[r] = np.roll(a, 2) * np.roll(b, 1) * c
        return self.runs[r]

    def bundle(self, text):
        out = np.zeros(self.dimensions)
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            padded = f" {word} "
            for i in range(len(padded) - 2):
                out += self.run(padded[i : i + 3])
        return out

    def unit(self, v):
        size = np.sqrt((v * v).sum())
        return v / size if size else v

    def train(self, rows):
        sums = {}
        for text, lang in rows:
            if text is not None and lang is not None:
                sums[lang] = sums.get(lang, 0) + self.unit(self.bundle(text))
        self.prototypes = {lang: np.round(self.unit(v), 6) for lang, v in sorted(sums.items())}

    def predict(self, text):
        if not re.search(r"[^\W\d_]", text or ""):
            return "und", 0.0
        unit = self.unit(self.bundle(text))
        cosines = {lang: round(float(unit @ v), 6) for lang, v in self.prototypes.items()}
        best = max(cosines, key=cosines.get)
        return best, min(1.0, max(0.0, cosines[best]))


def test_language_by_hand(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    own = Profiles()
    own.train((r["text"], r["lang"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2)
    got = {r["doc_id"]: r for r in queries.op7_language(spark, SF).collect()}
    for r in rows:
        lang, score = own.predict(r["text"])
        assert got[r["doc_id"]]["lang_pred"] == lang
        assert got[r["doc_id"]]["score"] == pytest.approx(score, abs=3e-6)


def test_quality_logits_by_double_sum():
    texts = [prose(40, 1), "", "One two. THREE! 4#", prose(300, 2)]
    raw, at = textvec.utf8(pa.array(texts))
    doc, item, value = quality.features(raw, at, np.array([np.nan, 0, 3, 90]))
    r = np.random.default_rng(1)
    model = {"w": r.normal(size=quality.FEATURES), "v": r.normal(size=(quality.FEATURES, 3)), "bias": 0.25}
    got = quality.logits(doc, item, value, len(texts), model)
    for k in range(len(texts)):
        own = [(int(i), float(x)) for d, i, x in zip(doc, item, value, strict=True) if d == k]
        want = model["bias"] + sum(model["w"][i] * x for i, x in own)
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                want += float(model["v"][own[a][0]] @ model["v"][own[b][0]]) * own[a][1] * own[b][1]
        assert got[k] == pytest.approx(want, abs=1e-5)
        words = [x for i, x in own if i < quality.WORD_BUCKETS]
        assert not words or sum(x * x for x in words) == pytest.approx(1, abs=1e-4)


def test_toxicity_features_by_hand(spark):
    texts = ["Dumb über-idiot!", "a  nice, WARM day", "idiot idiot", "", "über warm day"]
    buckets = toxicity.BUCKETS
    runs = []
    for t in texts:
        plain = " " + re.sub(r"[\W_]+", " ", t.lower()) + " "
        plain = re.sub(" +", " ", plain)
        runs.append({plain[i : i + k] for k in (5, 8) for i in range(len(plain) - k + 1)})
    doc, bucket = toxicity.distinct(*toxicity.grams(texts, (5, 8), buckets), buckets)
    assert [int((doc == k).sum()) for k in range(len(texts))] == [len(r) for r in runs]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, least_seen=1, least_errors=0.0)
    seen = [Counter(x for k in own for x in runs[k]) for own in ((1, 4), (0, 2))]
    for k, own in enumerate(seen):
        assert sum(own.values()) == sum(len(runs[j]) for j in ((1, 4), (0, 2))[k])
    counts = np.array([[2, 0, 1], [0, 2, 1]])
    want = [math.log((t + 1) / 6) - math.log((c + 1) / 6) for c, t in zip(*counts.tolist(), strict=True)]
    assert toxicity.log_ratios(counts).tolist() == pytest.approx(want)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert got[0] > 0.5 and got[2] > 0.5 and got[1] < 0.5 and got[4] < 0.5


def test_toxicity_fit_does_not_depend_on_the_dealing(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["mild", "warm", "dumb", "idiot"][: 2 + 2 * (i % 2)]) for _ in range(30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    a, b = toxicity.train(docs.repartition(1), labels), toxicity.train(docs.repartition(7), labels)
    assert np.array_equal(a["weights"], b["weights"]) and a["bias"] == b["bias"]


def test_bpe_at_the_borders_of_its_ways():
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    tokenizer, own = tokenizers.Tokenizer.from_file(path), bpe.Codec(bpe.load_vocabulary(path))
    r = random.Random(2)
    sizes = (*range(1, 70), *range(bpe.SCAN_LIMIT - 2, bpe.SCAN_LIMIT + 3), 1000)
    texts = ["".join(r.choice("theran") for _ in range(n)) for n in sizes]
    for many in (bpe.MANY_WORDS, bpe.MANY_WORDS + 1):
        texts.append(" ".join("".join(r.choice("abcé") for _ in range(r.randint(1, 12))) + str(i) for i in range(many)))
    for text, got in zip(texts, own.digests(texts), strict=True):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert got == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    for w in texts[:80]:
        assert own.merge_long([own.id_of_byte[b] for b in w.encode()]) == own.merge(w.encode())


def test_bpe_decodes_its_own_ids():
    """A vocabulary whose ids stand for other bytes gives other texts."""
    own = bpe.Codec(bpe.load_vocabulary(queries.vocabulary_path()))
    text = "Some words, and more words."
    ids = own.encode(text)
    own.bytes_of[ids[1]] = b"\xff?"
    own.raw = bpe.Pieces(own.bytes_of)
    want = own.decode(ids)
    assert want != text.encode() and "�" in want.decode()
    assert own.digests([text])[0][2] == hashlib.sha256(want).hexdigest()


def test_bpe_refuses_special_tokens_that_take_spaces(tmp_path):
    import json

    with open(queries.vocabulary_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="isn't plain"):
        bpe.load_vocabulary(str(tmp_path / "v.json"))


def test_pii_in_texts_of_many_spans(spark):
    texts = [" ".join(f"mail a{i}@b.de or 10.0.{i % 300}.7 +49 30 123456{i % 10}" for i in range(n)) for n in (0, 1, 2, 3, 31, 32, 33, 63, 64, 65, 11_000)]
    texts.append("bank " + " ".join(["DE89370400440532013000"] * 3000))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = [k.name for k in pii.KINDS if k.base]
    found = pii.find(docs)
    got = {r["doc_id"]: r for r in found.select("doc_id", pii.joined(base).alias("spans"), "iban", "email").collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i]["spans"].split(",") if s] == [s for k in base for s in base_spans(t)[k]]
        assert {s["score"] for s in got[i]["email"]} <= {1.0}
    assert [s["start"] for s in got[len(texts) - 1]["iban"]] == [5 + 23 * i for i in range(3000)]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[2] == "mail <email> or <ip> <phone> mail <email> or <ip> <phone>"
    assert clean[10].count("<email>") == 11_000 and "@" not in clean[10]


def test_pii_context_reaches_over_blocks(spark):
    for gap in range(pii.BLOCK - 60, pii.BLOCK + 60, 7):
        text = "x" * gap + " ssn " + "y" * 20 + " 123-45-6789 "
        docs = spark.createDataFrame([(1, text), (2, text.replace("ssn", "sxn"))], "doc_id long, text string")
        got = {r["doc_id"]: r["ssn"] for r in pii.find(docs).select("doc_id", "ssn").collect()}
        assert [(s["start"], s["end"]) for s in got[1]] == [(gap + 26, gap + 37)] and got[2] == []


def test_decontaminate_in_both_ways(spark):
    """The table of items just below and above what is indexed at once; ids that are strings."""
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    items = [(f"i{r['item_id']}", r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()] + [("z", "the of"), ("y", docs[3][1])]
    size = sum(-(-len(t or "") // 2) for _, t in items)
    frame, listed = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")
    want = brute_leaks(dict(docs), items)
    assert any(r[4] for r in want.values()) and not all(r[4] for r in want.values())
    for block_words in (-(-size // 3), size // 3 - 1):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.decontaminate(frame, listed, block_words=block_words).collect()}
        assert got == want
        kept = decontaminate.keep_clean(frame.withColumnRenamed("doc_id", "row"), listed, block_words=block_words)
        assert kept.columns == ["row", "text"]
        assert sorted(r["row"] for r in kept.collect()) == sorted(i for i, r in want.items() if not r[4])


def test_near_dedup_in_blocks(spark, monkeypatch):
    """A crowd of many components, in blocks bounded by documents and cells."""
    r = random.Random(8)
    base = prose(80, 11).split()
    texts = {}
    for i in range(140):
        w = list(base)
        for j in r.sample(range(len(w)), r.choice((0, 1, 2, 4, 8))):
            w[j] = f"n{r.randrange(40)}"
        texts[i] = " ".join(w)
    want = brute_classes(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for nodes, cells, crowd, few in ((16, 64, 2, 256), (4096, 1 << 24, 24, 256), (4096, 1 << 22, 2, 8)):
        monkeypatch.setattr(near_dedup, "BLOCK_NODES", nodes)
        monkeypatch.setattr(near_dedup, "FEW", few)
        monkeypatch.setattr(near_dedup, "CELLS", cells)
        monkeypatch.setattr(near_dedup, "CROWD", crowd)
        got = {x["doc_id"]: x["class_id"] for x in near_dedup.classes(docs, bands=60, rows=2).collect()}
        assert got == want
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    joined = {i: {i} for i in texts}
    for x in near_dedup.links(docs, bands=60, rows=2).collect():
        a, b = sets[x["a"]], sets[x["b"]]
        assert x["similarity"] == pytest.approx(len(a & b) / len(a | b)) and x["similarity"] >= 0.8
        both = joined[x["a"]] | joined[x["b"]]
        for i in both:
            joined[i] = both
    first = {t: i for i, t in sorted(texts.items(), reverse=True)}
    assert {i: min(joined[first[t]]) for i, t in texts.items()} == want


def test_small_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    for files, limit, parts in ((1, None, cores), (cores + 1, None, None), (1, 1, None)):
        path = f"{tmp_path}/{files}-{limit}"
        spark.range(200).repartition(files).write.parquet(path)
        monkeypatch.setattr(shared, "SPLIT_BYTES", limit or 128 << 20)
        rows = spark.read.parquet(path)
        dealt = shared.spread(rows)
        assert sorted(r["id"] for r in dealt.collect()) == list(range(200))
        assert dealt.rdd.getNumPartitions() == (parts or rows.rdd.getNumPartitions())


def test_a_crowd_of_near_nodes_in_little_memory():
    """8,192 texts of 100 shingles of which any two share 95 or more, each its own component."""
    r = np.random.default_rng(3)
    n, base = 8192, np.arange(1, 101, dtype=np.int64)
    items = np.tile(base, (n, 1))
    items[np.arange(n)[:, None], r.integers(0, 100, (n, 2))] = r.integers(1 << 40, 1 << 50, (n, 2))
    size = np.array([len(np.unique(x)) for x in items])
    flat = np.concatenate([np.unique(x) for x in items])
    tracemalloc.start()
    links = near_dedup.joining_links(np.arange(n), np.arange(n), size, flat, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(links) == n - 1 and min(x[2] for x in links) >= 0.8 and peak < 300e6


def test_word_sequences_are_told_apart(spark):
    texts = ["a b c", "A, b\tC!", "ab c", "a bc", "c b a", "a b c c", " a b c", "", "-", "ü b", "u b"]
    raw, at = textvec.utf8(pa.array(texts))
    prints = near_dedup.sequence_prints(textvec.Words(raw, at), at)
    assert prints[0] == prints[1] == prints[6] and prints[7] == prints[8]
    assert len(set(prints)) == 8


def test_recall_by_band():
    """Pairs of 200 shingles each: the share that meets in a bucket, by similarity."""
    r = np.random.default_rng(6)
    n, pairs = 200, 400
    for similarity, least in ((0.8, 0.995), (0.9, 1.0)):
        common = round(2 * n * similarity / (1 + similarity))
        doc, item = [], []
        for k in range(pairs):
            own = r.integers(0, 1 << 63, 2 * n - common).astype(np.uint64)
            doc += [2 * k] * n + [2 * k + 1] * n
            item += [own[:n], own[n - common :]]
        keys, _ = near_dedup.bucket_keys(np.array(doc), np.concatenate(item), np.ones(len(doc)), 2 * pairs, near_dedup.BANDS, near_dedup.ROWS)
        keys = keys.reshape(pairs, 2, -1)
        met = (keys[:, 0] == keys[:, 1]).any(axis=1)
        assert met.mean() >= least


def test_exact_dedup_of_a_hot_text(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 > 0 then 'the same  text' else concat('text ', id) end as text").repartition(5)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.decide(docs).collect()}
    assert got == {i: (1, 2000, i == 1) if i % 3 else (i, 1, True) for i in range(3000)}
