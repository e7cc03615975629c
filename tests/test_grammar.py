"""Stems and finite sentences against all sequences of tags and by hand."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from brindle.functions import grammar
from brindle.plans import recipes

SF = "/root/testdata/sf0.001"


def test_best_tags_are_the_best_of_all():
    r = random.Random(2)
    words = ["the", "she", "runs", "walked", "can", "quick", "fox", "and", "of", "is", "gladly", "houses", ",", "go"]
    for size in (1, 2, 4):
        sentences = [[r.choice(words) for _ in range(size)] for _ in range(25)]
        weights = np.array([[grammar.emission(w) for w in s] for s in sentences])
        found = grammar.best_tags(weights)
        score = lambda k, tags: sum(weights[k, t, g] + grammar.TRANSITION[tags[t - 1] if t else grammar.MARK, g] for t, g in enumerate(tags))
        for k in range(len(sentences)):
            allowed = [np.flatnonzero(weights[k, t] > grammar.NEVER) for t in range(size)]
            assert score(k, found[k]) == max(score(k, tags) for tags in itertools.product(*allowed))


def test_finite_sentences_by_hand():
    yes = ["The dog runs in the garden.", "She can swim.", "They are here.", "The houses of the town are old.", "It must be so."]
    no = ["Running in the garden.", "The old house.", "Gladly and soon!", "She walked home.", "", "...", "Is", "Can the"]
    assert grammar.finite(yes).all() and not grammar.finite(no).any()
    many = [" ".join(["The dog"] * k + ["runs"]) for k in range(1, 200)] + ["x " * 30_000]
    assert grammar.finite(many)[:199].all()


def test_stems(spark):
    want = {"ponies": "pony", "classes": "class", "running": "runn", "kindness": "kind", "nations": "nation", "is": "is", "bus": "bus", "relational": "relate", "happily": "happi", "glass": "glass", "stopped": "stopp", "organization": "organize", "": ""}
    rows = spark.createDataFrame([(w,) for w in want], "w string")
    assert {r["w"]: r["s"] for r in rows.select("w", grammar.stem(F.col("w")).alias("s")).collect()} == want


def test_query_over_documents(spark):
    from brindle.operators import screens

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = {r["doc_id"]: r["s"] for r in docs.select("doc_id", screens.sentences(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    got = recipes.finite_sentences(spark, SF).collect()
    assert len(got) == len(parts) and any(r["finite"] for r in got)
    for r in got:
        assert (r["sentences"], r["finite"]) == (len(parts[r["doc_id"]]), sum(bool(grammar.finite([s])[0]) for s in parts[r["doc_id"]]))


def test_finite_sentences_hold_few_words():
    """A batch of many sentences is tagged in pieces: Python holds far less than all its words."""
    import tracemalloc

    import pandas as pd

    row = ["The old house stands near the river, and nobody goes there now.", "No verb here.", ""] * 2000
    batch = pd.Series([row, None, [], row] + [row] * 10)
    tracemalloc.start()
    got = grammar.finite_count.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    each = int(grammar.finite(row).sum())
    assert got.tolist() == [each, 0, 0, each] + [each] * 10 and each == 2000
    assert peak < 60 << 20
