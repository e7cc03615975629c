"""The corpus pipeline against a brute-force version on the smallest tables."""

import hashlib
import re

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from brindle.llm import queries
from tests.llm.test_edges import rows
from tests.llm.test_methods import Profiles
from tests.llm.test_queries import SF, brute_classes, brute_leaks


def test_pipeline(spark):
    tokenizers = pytest.importorskip("tokenizers")
    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    profiles = Profiles()
    profiles.train((r["text"], r["lang"]) for r in table)
    docs = {r["doc_id"]: r["text"] for r in table}
    docs = {i: t for i, t in docs.items() if profiles.predict(t)[1] > 3 / 1024**0.5}
    first = {}
    for i in sorted(docs):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[i]), i)
    docs = {i: docs[i] for i in first.values()}
    classes = brute_classes(docs)
    docs = {i: t for i, t in docs.items() if classes[i] == i}
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    leaks = brute_leaks(docs, items)
    docs = {i: t for i, t in docs.items() if not leaks[i][4]}
    tokenizer = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    want = {}
    for i, t in docs.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_the_columns_and_bear_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "decontaminate", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.filter("false"), SF)
        assert out.columns == docs.columns
        assert out.count() == 0


def test_pipeline_bears_nulls_long_texts_and_repeated_rows(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    data = [(i, t) for i, t in rows() if not (t or "").startswith("another text")]
    data += [(200, data[6][1]), (6, data[6][1]), (None, "Some words that no other row has."), (201, "the cat and the dog sat on a mat and looked at one another for a long time")]
    taught = lambda i: "en" if i in (6, 8, 201) else None
    items = [(1, "dog sat on a mat and looked at one another"), (2, None), (3, "")]
    frame = spark.createDataFrame([(i, t, taught(i), None, None, "x", 1) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long, label string, row long")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    profiles = Profiles()
    profiles.train((t, taught(i)) for i, t in data)
    docs = [(i, t) for i, t in data if profiles.predict(t)[1] > 3 / 1024**0.5]
    assert 0 < len(docs) < len(data)
    first = {}
    for i, t in sorted(docs, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    classes = brute_classes({i: t for i, t in first.values() if i is not None})
    docs = [(i, t) for i, t in first.values() if i is None or classes[i] == i]
    docs = [(i, t) for i, t in docs if not brute_leaks({0: t}, items)[0][4]]
    tokenizer = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    want = sorted((str(i), len(ids := tokenizer.encode(t, add_special_tokens=False).ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
