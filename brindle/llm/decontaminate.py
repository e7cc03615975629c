"""Benchmark decontamination by winnowed fingerprints.

Every text is cut into words (``textvec``).  A fingerprint is the smallest ``gram``-word
hash in a sliding window of ``window - gram + 1`` such hashes.  A run of ``window`` words
covers exactly one sliding window, whose minimum depends on those words alone, so every
run that a document shares with an item shares a fingerprint.  A shared fingerprint is
extended: each window around it is looked up, word for word, among the item's windows.

An item side of up to ``block_words`` words (its size is measured) is indexed once and
broadcast: one pass over the documents, no shuffle.  A larger one is never gathered: the
documents are written with a row number, fingerprints of both sides are joined as tables,
the documents with a shared one give the windows around it, and these are joined with the
items' windows, word for word; no list of items or documents comes to the driver.

Cases: null or empty text has no words; very long texts are read whole; an item of fewer
words than ``window``, but not none, is one window; an item without words never hits; a
null ``item_id`` still marks words but isn't listed; repeated items count once by id (ids of
any type are compared as strings); documents that share a ``doc_id`` stay separate rows; an
empty table of documents gives no rows, one of items no hits; other columns are kept by
``keep_clean`` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import shared
from brindle.llm.textvec import Words, slices, utf8

WINDOW = 10
GRAM = 5
BLOCK_WORDS = 200_000


class ItemIndex:
    """Fingerprints and windows of one block of items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        #: Hashes of whole items of fewer words than the window, by their number of words.
        self.short: dict[int, np.ndarray] = {}
        holders: dict[bytes, set[str | None]] = defaultdict(set)
        marks = [np.zeros(0, np.uint64)]
        raw, at = utf8(pa.array([text for _, text in items], pa.large_string()))
        for first, last, part, offsets in slices(raw, at):
            words = Words(part, offsets)
            marks.append(fingerprints(words, window, gram)[1])
            short: dict[int, set[int]] = defaultdict(set)
            for k in range(last - first):
                i, j = words.first[k], words.first[k + 1]
                size = int(min(window, j - i))
                for s in range(i, j - size + 1) if size else ():
                    holders[words.text(s, s + size)].add(items[first + k][0])
                if 0 < size < window:
                    short[size].add(int(i))
            for size, starts in short.items():
                spot, h = words.grams(size)
                whole = h[np.isin(spot, list(starts))]
                self.short[size] = np.union1d(self.short.get(size, np.zeros(0, np.uint64)), whole)
        self.marks = np.unique(np.concatenate(marks))
        self.items_of = {text: sorted(ids - {None}) for text, ids in holders.items()}


def fingerprints(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: the first smallest gram hash of every ``window``-word run, as the index of
    the gram's first word and its hash; each position once."""
    at, h = words.grams(gram)
    span = window - gram + 1
    n = len(at) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    same = (at[span - 1 :] - at[:n]) == span - 1
    same &= words.doc[at[span - 1 :]] == words.doc[at[:n]]
    least, where = h[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, span):
        other = h[j : j + n]
        less = other < least
        least[less] = other[less]
        where[less] = j
    chosen = np.unique((np.arange(n) + where)[same])
    return at[chosen], h[chosen]


def is_member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted array ``among``."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    spot = np.searchsorted(among, values)
    spot[spot == len(among)] = 0
    return among[spot] == values


def hits(words: Words, index: ItemIndex) -> tuple[dict[int, set[int]], dict[int, set[str]]]:
    """By document of the slice: the words hit (from its first word) and the items found."""
    at, h = fingerprints(words, index.window, index.gram)
    tries: dict[int, set[tuple[int, int]]] = defaultdict(set)
    back = index.window - index.gram
    for w in at[is_member(h, index.marks)].tolist():
        doc = int(words.doc[w])
        low, high = words.first[doc], words.first[doc + 1]
        for s in range(max(low, w - back), min(w, high - index.window) + 1):
            tries[doc].add((int(s), index.window))
    for size, marks in index.short.items():
        at, h = words.grams(size)
        for w in at[is_member(h, marks)].tolist():
            tries[int(words.doc[w])].add((w, size))
    hit, found = defaultdict(set), defaultdict(set)
    for doc, spots in tries.items():
        for s, size in spots:
            items = index.items_of.get(words.text(s, s + size))
            if items is not None:
                origin = int(words.first[doc])
                hit[doc].update(range(s - origin, s - origin + size))
                found[doc].update(items)
    return hit, found


def listed(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))


def small_index(items: DataFrame, block_words: int, window: int, gram: int) -> ItemIndex | None:
    """The index of all items, if they can't have more than ``block_words`` words."""
    size = items.agg(F.sum(F.ceil(F.length("text") / 2))).first()[0] or 0
    return ItemIndex([tuple(r) for r in items.collect()], window, gram) if size <= 3 * block_words else None


def digest(ids: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: words, hit words, items found, their digest, and the verdict."""
    docs, items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), listed(benchmark)
    index = small_index(items, block_words, window, gram)
    if index is not None:
        return docs.mapInArrow(_reporter(docs.sparkSession.sparkContext.broadcast(index)), RESULT)
    rows = shared.materialize(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = joined_hits(rows.select("row", "text"), items, window, gram)
    places = found.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("place")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = found.filter("item_id is not null").select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    counted = rows.select("row", "doc_id", "text").mapInArrow(_counter, "row long, doc_id long, n_words long")
    none = F.array().cast("array<string>")
    merged = counted.join(places, "row", "left").join(named, "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"))
    return merged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, of which no word is hit."""
    items = listed(benchmark)
    index = small_index(items, block_words, window, gram)
    if index is not None:
        return docs.mapInArrow(_sieve(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    own = "row"
    while own in docs.columns:
        own += "_"
    rows = shared.materialize(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    hit = joined_hits(rows.select(F.col(own).alias("row"), "text"), items, window, gram).select(F.col("row").alias(own)).distinct()
    return rows.join(shared.materialize(hit, "hit"), own, "left_anti").select(*docs.columns)


def joined_hits(rows: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """row, start, size, item_id: every occurrence in a row of an item's window, by joins of
    written tables."""
    known = items.mapInArrow(_item_windows(window, gram), "item_id string, size int, mark long, words binary")
    known = shared.materialize(known, "windows")
    sizes = [r["size"] for r in known.select("size").distinct().collect()]  # at most ``window``
    marks = shared.materialize(known.select("mark").distinct(), "marks")
    own = rows.mapInArrow(_marker(window, gram, sizes), "row long, marks array<long>").select("row", F.explode("marks").alias("mark"))
    shared_marks = own.join(marks, "mark", "left_semi").groupBy("row").agg(F.collect_list("mark").alias("marks"))
    texts = rows.join(shared.materialize(shared_marks, "shared"), "row")
    tries = shared.materialize(texts.mapInArrow(_windows_at(window, gram, sizes), "row long, start int, size int, words binary"), "tries")
    return shared.materialize(tries.join(known.select("item_id", "size", "words").distinct(), ["size", "words"]).select("row", "start", "size", "item_id"), "hits")


def _scan(column: pa.Array, index: ItemIndex) -> Iterator[tuple[int, int, Words, dict, dict]]:
    raw, at = utf8(column)
    for first, last, part, offsets in slices(raw, at):
        words = Words(part, offsets)
        yield first, last, words, *hits(words, index)


def _reporter(index):
    def run(batches):
        none = digest(set())
        for batch in batches:
            n_words, n_hit, n_items, sha = [], [], [], []
            for first, last, words, hit, found in _scan(batch["text"], index.value):
                n_words += np.diff(words.first).tolist()
                for k in range(last - first):
                    n_hit.append(len(hit[k]) if k in hit else 0)
                    n_items.append(len(found[k]) if k in found else 0)
                    sha.append(digest(found[k]) if k in found else none)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return run


def _counter(batches):
    for batch in batches:
        raw, at = utf8(batch["text"])
        for first, last, part, offsets in slices(raw, at):
            count = np.diff(Words(part, offsets).first)
            yield pa.RecordBatch.from_arrays([batch["row"].slice(first, last - first), batch["doc_id"].slice(first, last - first), pa.array(count, pa.int64())], ["row", "doc_id", "n_words"])


def marked(words: Words, window: int, gram: int, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Places, hashes and size of what may be shared: fingerprints of windows, and whole runs
    of the sizes of shorter items."""
    return [(*fingerprints(words, window, gram), window), *((*words.grams(k), k) for k in sorted(sizes) if k < window)]


def placed(at: np.ndarray, mark: np.ndarray) -> list[tuple[int, int]]:
    return list(zip(at.tolist(), mark.view(np.int64).tolist(), strict=True))


def _marker(window: int, gram: int, sizes: list[int]):
    def run(batches):
        for batch in batches:
            raw, at = utf8(batch["text"])
            for first, last, part, offsets in slices(raw, at):
                words = Words(part, offsets)
                found = marked(words, window, gram, sizes)
                doc = np.concatenate([words.doc[w] for w, _, _ in found])
                mark = np.concatenate([h for _, h, _ in found]).view(np.int64)
                order = np.lexsort((mark, doc))
                doc, mark = doc[order], mark[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
                bounds = np.searchsorted(doc[new], np.arange(last - first + 1))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(mark[new]))
                yield pa.RecordBatch.from_arrays([batch["row"].slice(first, last - first), lists], ["row", "marks"])

    return run


def _windows_at(window: int, gram: int, sizes: list[int]):
    """The windows around the shared marks of each row, each once, with their words."""

    def run(batches):
        for batch in batches:
            raw, at = utf8(batch["text"])
            lists = batch["marks"]
            for first, last, part, offsets in slices(raw, at):
                words = Words(part, offsets)
                row, start, size, text = [], [], [], []
                wanted = [set(x) for x in lists.slice(first, last - first).to_pylist()]
                tries: set[tuple[int, int, int]] = set()
                for w, h, k in marked(words, window, gram, sizes):
                    for i, mark in placed(w, h):
                        doc = int(words.doc[i])
                        if mark in wanted[doc]:
                            low, high = int(words.first[doc]), int(words.first[doc + 1])
                            spots = range(max(low, i - window + gram), min(i, high - window) + 1) if k == window else (i,)
                            tries.update((doc, s, k) for s in spots)
                for doc, s, k in sorted(tries):
                    row.append(batch["row"][first + doc].as_py())
                    start.append(s - int(words.first[doc]))
                    size.append(k)
                    text.append(words.text(s, s + k))
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(text, pa.binary())], ["row", "start", "size", "words"])

    return run


def _item_windows(window: int, gram: int):
    """Every window of every item with the marks that lead to it."""

    def run(batches):
        for batch in batches:
            raw, at = utf8(batch["text"])
            for first, last, part, offsets in slices(raw, at):
                words = Words(part, offsets)
                count = np.diff(words.first)
                item, size, mark, text = [], [], [], []
                names = batch["item_id"].slice(first, last - first).to_pylist()

                def add(s: int, k: int, h: int) -> None:
                    item.append(names[words.doc[s]])
                    size.append(k)
                    mark.append(h)
                    text.append(words.text(s, s + k))

                at_mark = dict(placed(*fingerprints(words, window, gram)))
                for k in np.unique(count[(count > 0) & (count < window)]).tolist():
                    for s, h in placed(*words.grams(k)):
                        if count[words.doc[s]] == k:
                            add(s, k, h)
                for doc in np.flatnonzero(count >= window).tolist():
                    for s in range(words.first[doc], words.first[doc + 1] - window + 1):
                        for i in range(s, s + window - gram + 1):
                            if i in at_mark:
                                add(s, window, at_mark[i])
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(size, pa.int32()), pa.array(mark, pa.int64()), pa.array(text, pa.binary())], ["item_id", "size", "mark", "words"])

    return run


def _sieve(index):
    def run(batches):
        for batch in batches:
            clean = []
            for first, last, _, hit, _ in _scan(batch["text"], index.value):
                clean += [not hit.get(k) for k in range(last - first)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run
