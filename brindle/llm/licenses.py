"""Licence notices by a positional index of rare words.

Templates are known notices with the phrases that a notice must have.  Every licence word
has a weight, 1 + floor(1000 ln((2N + 2) / (2 df + 1))), from its document frequency among all
documents.  A template's posting is the heaviest word of its mandatory phrases with its place
there.  In a document the postings of its heaviest licence words give the places where a
template may lie; the other words are intersected by relative position.  A notice stands
where every word of the mandatory phrases does and the words in place weigh at least
``share`` of the template.  As a posting's word is mandatory, no such place is missed.

Words are those of ``textvec``; a licence word is recognised by a 64-bit hash and then byte
by byte.  Base phrases are templates that are mandatory as a whole.

Two scans, no shuffle but one row a licence word and task.  Cases: null and empty texts have
no words; very long texts are read whole; overlapping notices all count; repeated rows and
ids stay separate rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.textvec import Words, slices, utf8

SHARE = 0.6

#: Label, notice, mandatory phrases (each once in the notice). Base: fixed values.
BASE = [
    ("cc-by", "cc by", ["cc by"]),
    ("gpl", "general public license", ["general public license"]),
    ("reserved", "all rights reserved", ["all rights reserved"]),
]
NOTICES = [
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("epl-2.0", "made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "fee is hereby granted"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]
RESULT = "doc_id long, n_words long, notices array<struct<label:string,start:long,stop:long,share:double,base:boolean>>"


@dataclass
class Template:
    label: str
    words: list[str]
    #: Places of the words of mandatory phrases.
    keys: list[int]
    base: bool


def templates(base=None, notices=None) -> list[Template]:
    out = []
    for is_base, rows in ((True, BASE if base is None else base), (False, NOTICES if notices is None else notices)):
        for label, notice, phrases in rows:
            words, keys = notice.split(), set()
            for phrase in map(str.split, phrases):
                at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
                keys |= set(range(at, at + len(phrase)))
            out.append(Template(label, words, sorted(keys), is_base))
    return out


class Vocabulary:
    """The words of all templates, told from others by hash and bytes."""

    def __init__(self, known: list[Template]):
        words = sorted({w for t in known for w in t.words})
        raw, at = utf8(pa.array(words, pa.large_string()))
        found = Words(raw, at)
        order = np.argsort(found.hash)
        self.words = [words[i] for i in order]
        self.hash = found.hash[order]
        self.bytes = [np.frombuffer(w.encode(), np.uint8) for w in self.words]

    def ids(self, words: Words) -> np.ndarray:
        """The number of each word, -1 for words of no template."""
        spot = np.searchsorted(self.hash, words.hash)
        spot[spot == len(self.hash)] = 0
        hit = np.flatnonzero(self.hash[spot] == words.hash)
        out = np.full(len(words.hash), -1, np.int32)
        order = hit[np.argsort(spot[hit], kind="stable")]
        for i, rows in zip(*_runs(spot[order], order), strict=True):
            own = self.bytes[i]
            rows = rows[words.end[rows] - words.start[rows] == len(own)]
            same = (words.low[words.start[rows][:, None] + np.arange(len(own))] == own).all(axis=1)
            out[rows[same]] = i
        return out


def _runs(key: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Distinct keys of a sorted array, and the values of each."""
    found, first = np.unique(key, return_index=True)
    return found.tolist(), np.split(values, first[1:]) if len(found) else []


def word_weights(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Weight of each licence word over all documents."""
    parts = docs.select("text").mapInArrow(_counter(vocabulary), "word int, n long")
    count = {r["word"]: r["n"] for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n = count.get(-1, 0)
    return np.array([1 + math.floor(1000 * math.log((2 * n + 2) / (2 * count.get(i, 0) + 1))) for i in range(len(vocabulary.words))], np.int64)


def _counter(vocabulary: Vocabulary):
    """Document frequency of each licence word in a task; documents under -1."""

    def run(batches):
        n, seen = 0, np.zeros(len(vocabulary.words), np.int64)
        for batch in batches:
            n += len(batch)
            raw, at = utf8(batch["text"])
            for first, last, part, offsets in slices(raw, at):
                words = Words(part, offsets)
                ids = vocabulary.ids(words)
                hit = np.flatnonzero(ids >= 0)
                pairs = np.unique(words.doc[hit] * len(seen) + ids[hit])
                seen += np.bincount(pairs % len(seen), minlength=len(seen))
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *there], pa.int32()), pa.array([n, *seen[there]], pa.int64())], ["word", "n"])

    return run


class Index:
    """Postings of the templates by their heaviest mandatory word."""

    def __init__(self, known: list[Template], vocabulary: Vocabulary, weights: np.ndarray, share: float = SHARE):
        self.vocabulary, self.share, self.templates = vocabulary, share, known
        number = {w: i for i, w in enumerate(vocabulary.words)}
        self.ids = [np.array([number[w] for w in t.words], np.int32) for t in known]
        self.weights = [weights[ids] for ids in self.ids]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(known):
            place = max(t.keys, key=lambda q: (self.weights[i][q], -q))
            self.postings.setdefault(int(self.ids[i][place]), []).append((i, place))

    def notices(self, words: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Template, start (word of the slice) and weight in place of every notice."""
        ids, out = self.vocabulary.ids(words), []
        hit = np.flatnonzero(ids >= 0)
        order = hit[np.argsort(ids[hit], kind="stable")]
        for word, places in zip(*_runs(ids[order], order), strict=True):
            for i, q in self.postings.get(word, ()):
                own, low, high = self.ids[i], words.first[words.doc[places]], words.first[words.doc[places] + 1]
                start, keys = places - q, self.templates[i].keys
                whole = (start + keys[0] >= low) & (start + keys[-1] < high)
                start, low, high = start[whole], low[whole], high[whole]
                for k in keys:
                    stays = ids[start + k] == own[k]
                    start, low, high = start[stays], low[stays], high[stays]
                weight = np.zeros(len(start), np.int64)
                for k in range(len(own)):
                    at = start + k
                    there = (at >= low) & (at < high)
                    weight[there] += self.weights[i][k] * (ids[at[there]] == own[k])
                heavy = weight >= self.share * self.weights[i].sum()
                out.append((np.full(heavy.sum(), i), start[heavy], weight[heavy]))
        return out


def scan(docs: DataFrame, known: list[Template] | None = None, share: float = SHARE) -> DataFrame:
    """doc_id, words and notices of every document; a notice has its label, the places of its
    first word and after its last (a notice cut off by the text's start begins below 0), and
    the share of the template's weight that stands in place."""
    known = templates() if known is None else known
    vocabulary = Vocabulary(known)
    index = Index(known, vocabulary, word_weights(docs, vocabulary), share)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanner(index), RESULT)


def _scanner(index: Index):
    size = np.array([len(t.words) for t in index.templates])
    total = np.array([w.sum() for w in index.weights])
    labels = np.array([t.label for t in index.templates], dtype=object)
    base = np.array([t.base for t in index.templates])

    def run(batches):
        for batch in batches:
            raw, at = utf8(batch["text"])
            for first, last, part, offsets in slices(raw, at):
                words = Words(part, offsets)
                found = index.notices(words)
                kind = np.concatenate([np.zeros(0, np.int64), *[x[0] for x in found]])
                start = np.concatenate([np.zeros(0, np.int64), *[x[1] for x in found]])
                weight = np.concatenate([np.zeros(0, np.int64), *[x[2] for x in found]])
                keyed = np.array([t.keys[0] for t in index.templates])[kind]
                doc = words.doc[start + keyed] if len(start) else start
                order = np.lexsort((kind, start, doc))
                kind, start, weight, doc = kind[order], start[order], weight[order], doc[order]
                own = start - words.first[doc]
                structs = pa.StructArray.from_arrays(
                    [pa.array(labels[kind], pa.string()), pa.array(own, pa.int64()), pa.array(own + size[kind], pa.int64()), pa.array(weight / total[kind], pa.float64()), pa.array(base[kind], pa.bool_())],
                    ["label", "start", "stop", "share", "base"],
                )
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(last - first + 1)), pa.int32()), structs)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, last - first), pa.array(np.diff(words.first), pa.int64()), lists], ["doc_id", "n_words", "notices"])

    return run


def digest(found: DataFrame) -> DataFrame:
    """One row a document: places of base phrases, labels, the largest share."""
    base = F.filter("notices", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"), named(F.col("notices")).alias("labels"), F.coalesce(F.array_max(F.transform("notices", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )
