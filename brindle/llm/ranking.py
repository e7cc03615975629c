"""Ranked lexical search: WAND over the shards of the documents.

Two scans of the documents for each block of queries.  The first counts, over all
documents, how many hold each query term and how many terms there are.  The second cuts each
task's documents into shards of bounded text, builds a shard's postings of the query terms
with the largest impact of each term, and runs WAND: every term of a query has a cursor; the
cursors are sorted by their document, the largest impacts are summed in this order, and where
the sum first reaches the score of the worst document in the query's heap stands the pivot.
No document before it can enter the heap, so all cursors go there at once.  The queries of a
block step together, each with a pivot and heap of its own, which makes a step a few
whole-array operations.  A task keeps its heaps from shard to shard; at most ``k`` rows a
query and task are shuffled, to be merged.

A term's weight is w = floor(1000 ln((2N + 2) / (2 df + 1))); a document with n of all L terms
has m = 100 - B + B n N div L; it scores w ((10**9 tf) div (1000 tf + 8 m)) for each term of the
query, repeats included.  All but the logarithm is in 64-bit whole numbers.

The queries are a stated set, gathered in blocks of about ``block_chars`` characters (their
lengths are summed first); only a block is broadcast.  Terms are told apart by 64-bit hashes.

Cases: null and empty texts have no terms, such documents aren't counted and never ranked, such
queries have no rows; equal scores go by ``doc_id``, null last; documents that share an id are
ranked each; queries that share an id have ranks of their own each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.decontaminate import is_member
from brindle.llm.shared import union_all
from brindle.llm.textvec import Words, slices, utf8

K = 10
#: The length's part in a score, in hundredths.
B = 75
BLOCK_CHARS = 1 << 20
SHARD_BYTES = 16 << 20


class Queries:
    """Terms of a block of queries: ``vocabulary`` (sorted hashes), and by query the numbers
    of its terms with their repeats, in rows filled up with -1 and 0."""

    def __init__(self, texts: list[str | None]):
        raw, at = utf8(pa.array(texts, pa.large_string()))
        hashes = [np.zeros(0, np.uint64)] * len(texts)
        for first, last, part, offsets in slices(raw, at):
            words = Words(part, offsets)
            for i in range(last - first):
                hashes[first + i] = words.hash[words.first[i] : words.first[i + 1]]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        counted = [np.unique(np.searchsorted(self.vocabulary, h), return_counts=True) for h in hashes]
        width = max([len(t) for t, _ in counted], default=0)
        self.terms, self.repeats = np.full((len(texts), width), -1, np.int64), np.zeros((len(texts), width), np.int64)
        for i, (t, n) in enumerate(counted):
            self.terms[i, : len(t)], self.repeats[i, : len(t)] = t, n


@dataclass
class Corpus:
    """Counts over all documents: documents with terms, terms, weight of each query term."""

    documents: int
    terms: int
    weights: np.ndarray


def term_counts(words: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document of the slice, number and count of every query term in it."""
    hit = np.flatnonzero(is_member(words.hash, vocabulary))
    key, tf = np.unique(words.doc[hit] * len(vocabulary) + np.searchsorted(vocabulary, words.hash[hit]), return_counts=True)
    return key // max(1, len(vocabulary)), key % max(1, len(vocabulary)), tf


def _counter(queries):
    """Of a task: documents with each query term; documents under -1, terms under -2."""

    def run(batches):
        vocabulary, n, total = queries.value.vocabulary, 0, 0
        seen = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            raw, at = utf8(batch["text"])
            for _, _, part, offsets in slices(raw, at):
                words = Words(part, offsets)
                n += int((np.diff(words.first) > 0).sum())
                total += len(words.hash)
                seen += np.bincount(term_counts(words, vocabulary)[1], minlength=len(seen))
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *there], pa.int32()), pa.array([n, total, *seen[there]], pa.int64())], ["term", "n"])

    return run


def corpus_counts(docs: DataFrame, queries, n_terms: int) -> Corpus:
    parts = docs.select("text").mapInArrow(_counter(queries), "term int, n long")
    count = {r["term"]: r["n"] for r in parts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = count.get(-1, 0)
    weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * count.get(i, 0) + 1))) for i in range(n_terms)]
    return Corpus(n, count.get(-2, 0), np.array(weights, np.int64))


@dataclass
class Shard:
    """Documents of a task until their text has ``SHARD_BYTES``."""

    ids: list = field(default_factory=list)
    length: list = field(default_factory=list)
    doc: list = field(default_factory=list)
    term: list = field(default_factory=list)
    tf: list = field(default_factory=list)
    size: int = 0

    def add(self, ids: list, words: Words, vocabulary: np.ndarray) -> None:
        doc, term, tf = term_counts(words, vocabulary)
        self.doc.append(doc + len(self.ids))
        self.term.append(term)
        self.tf.append(tf)
        self.ids += ids
        self.length.append(np.diff(words.first))
        self.size += len(words.low)


class Postings:
    """A shard's postings by term and document, with the largest impact of each term.

    Documents are numbered in the order of their ids, so that of equal scores the first met
    stays.  ``key`` is term * documents + document."""

    def __init__(self, shard: Shard, corpus: Corpus):
        n = len(shard.ids)
        order = sorted(range(n), key=lambda i: (shard.ids[i] is None, shard.ids[i] or 0))
        self.ids = [shard.ids[i] for i in order]
        number = np.empty(n, np.int64)
        number[order] = np.arange(n)
        doc, term, tf = (np.concatenate(x) for x in (shard.doc, shard.term, shard.tf))
        m = 100 - B + B * np.concatenate(shard.length).astype(np.int64) * corpus.documents // max(1, corpus.terms)
        impact = corpus.weights[term] * (10**9 * tf // (1000 * tf + 8 * m[doc]))
        key = term * n + number[doc]
        order = np.argsort(key)
        order = order[impact[order] > 0]
        self.n, self.key, self.impact = n, key[order], impact[order]
        self.doc = self.key % max(1, n)
        self.end = np.searchsorted(self.key, (np.arange(len(corpus.weights)) + 1) * n)
        self.start = np.concatenate([np.zeros(1, np.int64), self.end[:-1]])
        self.most = np.zeros(len(corpus.weights), np.int64)
        there = np.flatnonzero(self.end > self.start)
        if len(there):
            self.most[there] = np.maximum.reduceat(self.impact, self.start[there])


class Heaps:
    """The ``k`` best documents of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n)]
        #: A document that scores less can't enter.
        self.least = np.ones(n, np.int64)

    def offer(self, query: int, score: int, doc_id) -> None:
        heap = self.rows[query]
        row = (score, -math.inf if doc_id is None else -doc_id, doc_id is not None)
        if len(heap) < self.k:
            heapq.heappush(heap, row)
        elif row > heap[0]:
            heapq.heapreplace(heap, row)
        if len(heap) == self.k:
            self.least[query] = heap[0][0]


def wand(postings: Postings, queries: Queries, heaps: Heaps) -> int:
    """Bring a shard's documents into the heaps; the number of documents that were scored."""
    scored, far = 0, postings.n
    query = np.flatnonzero((queries.terms >= 0).any(axis=1)) if far else np.zeros(0, np.int64)
    term, repeats = np.maximum(queries.terms[query], 0), queries.repeats[query]
    if not len(query) or not len(postings.key):
        return 0
    at, end = postings.start[term], postings.end[term]
    bound = postings.most[term] * repeats
    end = np.where(bound > 0, end, at)
    last = len(postings.key) - 1
    here = np.where(at < end, postings.doc[np.minimum(at, last)], far)
    while len(query):
        order = np.argsort(here, axis=1)
        sums = np.cumsum(np.take_along_axis(np.where(here < far, bound, 0), order, axis=1), axis=1)
        reached = sums >= heaps.least[query][:, None]
        alive = reached[:, -1]
        if not alive.all():
            query, term, repeats, bound, at, end, here, order, reached = (x[alive] for x in (query, term, repeats, bound, at, end, here, order, reached))
            if not len(query):
                break
        spot = reached.argmax(axis=1)
        pivot = here[np.arange(len(query)), order[np.arange(len(query)), spot]]
        q, t = np.nonzero(here < pivot[:, None])
        if len(q):
            to = np.searchsorted(postings.key, term[q, t] * far + pivot[q])
            at[q, t] = to
            here[q, t] = np.where(to < end[q, t], postings.doc[np.minimum(to, last)], far)
        q, t = np.nonzero(here == pivot[:, None])
        score = np.bincount(q, postings.impact[at[q, t]] * repeats[q, t], minlength=len(query)).astype(np.int64)
        scored += len(query)
        for i in np.flatnonzero(score >= heaps.least[query]).tolist():
            heaps.offer(int(query[i]), int(score[i]), postings.ids[pivot[i]])
        to = at[q, t] + 1
        at[q, t] = to
        here[q, t] = np.where(to < end[q, t], postings.doc[np.minimum(to, last)], far)
    return scored


def _ranker(queries, corpus, k: int, shard_bytes: int):
    def run(batches):
        asked, counts = queries.value, corpus.value
        heaps, shard = Heaps(len(asked.terms), k), Shard()

        def close():
            if shard.ids:
                wand(Postings(shard, counts), asked, heaps)

        for batch in batches:
            raw, at = utf8(batch["text"])
            for first, last, part, offsets in slices(raw, at):
                shard.add(batch["doc_id"].slice(first, last - first).to_pylist(), Words(part, offsets), asked.vocabulary)
                if shard.size >= shard_bytes:
                    close()
                    shard = Shard()
        close()
        rows = [(i, -int(negative) if known else None, score) for i, heap in enumerate(heaps.rows) for score, negative, known in heap]
        for low in range(0, len(rows), 10_000):
            number, doc_id, score = zip(*rows[low : low + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], ["number", "doc_id", "score"])

    return run


def _best(docs: DataFrame, block: list, id_type, k: int, shard_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    asked = Queries([text for _, text in block])
    queries = spark.sparkContext.broadcast(asked)
    corpus = spark.sparkContext.broadcast(corpus_counts(docs, queries, len(asked.vocabulary)))
    rows = docs.mapInArrow(_ranker(queries, corpus, k, shard_bytes), "number int, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"number int, item_id {id_type}")
    return ranked.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = K, block_chars: int = BLOCK_CHARS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of every item."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = items.schema["item_id"].dataType.simpleString()
    n = math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars) or 1
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return union_all([_best(docs, [tuple(r) for r in items.filter(place == i).collect()], id_type, k, shard_bytes) for i in range(n)])
