"""Toxicity: a character n-gram classifier with naive Bayes scaled features.

A feature is the presence of a hashed run of 5 or 8 characters (``GRAMS``) of the lower-case
text, each run of characters that are neither letters nor digits being one space.  A
feature's value is the logarithm of the ratio of its smoothed frequencies in toxic and clean
training texts; a logistic regression with an elastic-net penalty is fitted on these values.

Fitting takes two passes over a sample of the labelled texts.  The first counts every feature
by label, added up by the executors; features that tell the labels apart (``LEAST_SEEN``,
``LEAST_ERRORS``: parameters of the model) are kept, and the second pass brings these alone
to the driver.  Features whose weight is zero are skipped when scoring, so a text costs one
table lookup per character.

Cases: null and empty texts have no features and get the score of the intercept; very long
texts are read whole; a document with several labels counts by their mean (toxic from 0.5,
ties included); null labels and labels without a document teach nothing; without labels of
both kinds the score is the share of toxic labels (0 without any); repeated rows are scored
alike; an empty table gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import shared
from brindle.llm.textvec import BASE, U, mix, slices, utf8

GRAMS = (5, 8)
BUCKETS = 1 << 20
#: Bound of the labelled rows that are fitted, half of them for each label (chosen by a
#: hash of the id).
TRAIN_ROWS = 4_000
#: A feature is used if so many texts of the sample have it, and its shares of toxic and
#: clean texts differ by so many standard errors.
LEAST_SEEN, LEAST_ERRORS = 3, 2.0
STEPS = 100
#: Weights of the elastic net's two penalties.
L1, L2 = 4e-4, 1e-5
SEED = 8


_IS_WORD: list[np.ndarray] = []


def is_word() -> np.ndarray:
    """By code point: whether it is a letter or a digit."""
    if not _IS_WORD:
        _IS_WORD.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    return _IS_WORD[0]


def grams(texts: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of every run of so many characters within a document, which has a
    space before and after its text."""
    n = len(texts)
    lower = [t.lower() for t in texts]
    size = np.fromiter(map(len, lower), np.int64, n)
    low = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.where(is_word()[low], low, 32)
    doc = np.repeat(np.arange(n), size + 2)
    text = np.full(len(low) + 2 * n, 32, U)
    text[np.arange(len(low)) + 2 * np.repeat(np.arange(n), size) + 1] = low
    keep = np.ones(len(text), dtype=bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32) | (doc[1:] != doc[:-1])
    text, doc = text[keep], doc[keep]
    docs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for gram in sizes:
        m = len(text) - gram + 1
        if m <= 0:
            continue
        total = np.full(m, gram, dtype=U)
        for j in range(gram):
            total += (text[j : j + m] + U(1)) * U(pow(BASE, j + 1, 1 << 64))
        inside = doc[:m] == doc[gram - 1 :]
        docs.append(doc[:m][inside])
        found.append((mix(total[inside]) >> U(64 - (buckets.bit_length() - 1))).astype(np.int64))
    return np.concatenate(docs), np.concatenate(found)


def distinct(doc: np.ndarray, bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(doc * buckets + bucket)
    return pair // buckets, pair % buckets


def _texts(column: pa.Array):
    """Runs of rows of bounded text: first, last, texts."""
    for first, last, _, _ in slices(*utf8(column)):
        yield first, last, [t or "" for t in column.slice(first, last - first).to_pylist()]


def _counts(sizes: tuple[int, ...], buckets: int):
    """How many clean and toxic texts of a task have each feature; feature -1 counts texts."""

    def run(batches):
        seen, texts = np.zeros((2, buckets), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            labels = batch["label"].to_numpy(zero_copy_only=False)
            for first, last, part in _texts(batch["text"]):
                doc, bucket = distinct(*grams(part, sizes, buckets), buckets)
                label = labels[first:last]
                texts += np.bincount(label, minlength=2)
                for k in (0, 1):
                    seen[k] += np.bincount(bucket[label[doc] == k], minlength=buckets)
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1], at]).astype(np.int32)), *(pa.array(np.concatenate([[texts[k]], seen[k][at]])) for k in (0, 1))], ["bucket", "clean", "toxic"]
        )

    return run


def _features(sizes: tuple[int, ...], buckets: int, place):
    """The features of each text that are kept, by their places among these."""

    def run(batches):
        for batch in batches:
            for first, last, part in _texts(batch["text"]):
                doc, bucket = distinct(*grams(part, sizes, buckets), buckets)
                kept = place.value[bucket]
                doc, kept = doc[kept >= 0], kept[kept >= 0]
                bounds = np.searchsorted(doc, np.arange(last - first + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(first, last - first), batch["label"].slice(first, last - first), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(kept, pa.int32()))],
                    ["doc_id", "label", "features"],
                )

    return run


def labelled(docs: DataFrame, labels: DataFrame, column: str, teaches, bound: int, seed: int, by_label: bool = False) -> DataFrame:
    """doc_id, text, label (0 or 1) of about ``bound`` labelled documents at most (of each label half of it, if asked)."""
    known = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    known = known.filter(teaches) if teaches is not None else known
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(column) >= 0.5).cast("int").alias("label"))
    if by_label:
        known = shared.union_all([shared.bounded_sample(known.filter(F.col("label") == label), "doc_id", bound // 2, seed) for label in (0, 1)])
    else:
        known = shared.bounded_sample(known, "doc_id", bound, seed)
    # The sample's bound bounds the broadcast.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")


def log_ratios(seen: np.ndarray) -> np.ndarray:
    """By feature: the logarithm of the ratio of its smoothed shares of the two labels, from
    clean and toxic counts."""
    clean, toxic = seen + 1.0
    return np.log(toxic / toxic.sum()) - np.log(clean / clean.sum())


def telling(seen: np.ndarray, texts: np.ndarray, least_seen: int, least_errors: float) -> np.ndarray:
    """The features seen often enough whose shares of the labels' texts differ by so many
    standard errors."""
    pooled = seen.sum(axis=0) / texts.sum()
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / texts[0] + 1 / texts[1]))
    apart = np.abs(seen[1] / texts[1] - seen[0] / texts[0]) >= least_errors * error
    return np.flatnonzero(apart & (seen.sum(axis=0) >= least_seen) & (log_ratios(seen) != 0))


def fit(batches: list[pa.RecordBatch], r: np.ndarray, steps: int = STEPS, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights of the features, whose values are ``r``, and the intercept, from batches of
    doc_id, label and features."""
    rows = []
    for label, ids, size, flat in _parts(batches):
        ends = np.cumsum(size)
        rows += [(i, y, own) for i, y, own in zip(ids, label.tolist(), np.split(flat, ends[:-1]), strict=True)]
    rows.sort(key=lambda x: (x[0], x[1], len(x[2])))
    y = np.array([x[1] for x in rows], np.float64)
    at = np.concatenate([[0], np.cumsum([len(x[2]) for x in rows])])
    item = np.concatenate([x[2] for x in rows])
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(at))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, bias, v, v_bias, t = np.zeros(len(r)), 0.0, np.zeros(len(r)), 0.0, 1.0
    # Accelerated proximal gradient; the step comes from a power iteration on the curvature.
    x = np.random.default_rng(SEED).standard_normal(len(r))
    for _ in range(8):
        x /= np.linalg.norm(x) + 1e-12
        x = r * np.bincount(item, (weight * _sums(x * r, item, at))[row], len(r))
    step = 1 / (0.25 * np.linalg.norm(x) * 1.5 + 0.5)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(_sums(v * r, item, at) + v_bias, -30, 30)))
        error = weight * (p - y)
        g = r * np.bincount(item, error[row], len(r)) + l2 * v
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_bias = v_bias - step * error.sum()
        t, old_t = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, v_bias = new + (old_t - 1) / t * (new - w), new_bias + (old_t - 1) / t * (new_bias - bias)
        w, bias = new, new_bias
    return w * r, float(bias)


def _parts(batches: list[pa.RecordBatch]):
    """Of each batch with rows: labels, ids, and the sizes and entries of its lists."""
    for batch in batches:
        if batch.num_rows:
            lists = batch["features"]
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch["label"].to_numpy(zero_copy_only=False), batch["doc_id"].to_pylist(), size, lists.flatten().to_numpy(zero_copy_only=False)


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _sums(values: np.ndarray, item: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values[item])])
    return total[at[1:]] - total[at[:-1]]


def train(
    docs: DataFrame, labels: DataFrame, teaches=None, bound: int = TRAIN_ROWS, sizes: tuple[int, ...] = GRAMS, buckets: int = BUCKETS,
    least_seen: int = LEAST_SEEN, least_errors: float = LEAST_ERRORS, l1: float = L1,
) -> dict:
    """The model, from ``labels.toxic`` of the label rows that ``teaches`` (a condition)
    holds for, about ``bound`` documents at most."""
    rows = labelled(docs, labels, "toxic", teaches, bound, SEED, by_label=True)
    counts = rows.mapInArrow(_counts(sizes, buckets), "bucket int, clean long, toxic long")
    counts = counts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    at, both = counts["bucket"].to_numpy(), np.stack([counts["clean"].to_numpy(), counts["toxic"].to_numpy()])
    seen = np.zeros((2, buckets), np.int64)
    seen[:, at[at >= 0]] = both[:, at >= 0]
    texts = both[:, at < 0].sum(axis=1)
    weights = np.zeros(buckets, np.float32)
    if not texts.all() or not len(texts):
        share = float(texts[1] / max(texts.sum(), 1))
        return {"weights": weights, "bias": _logit(min(max(share, 1e-6), 1 - 1e-6)), "sizes": sizes, "buckets": buckets}
    used = telling(seen, texts, least_seen, least_errors)
    place = np.full(buckets, -1, np.int32)
    place[used] = np.arange(len(used))
    kept = rows.mapInArrow(_features(sizes, buckets, docs.sparkSession.sparkContext.broadcast(place)), "doc_id long, label int, features array<int>").toArrow()
    weights[used], bias = fit(kept.to_batches(), log_ratios(seen)[used], l1=l1)
    return {"weights": weights, "bias": bias, "sizes": sizes, "buckets": buckets}


def logits(texts: list[str], model: dict) -> np.ndarray:
    doc, bucket = grams(texts, model["sizes"], model["buckets"])
    heavy = model["weights"][bucket] != 0
    doc, bucket = distinct(doc[heavy], bucket[heavy], model["buckets"])
    return np.bincount(doc, model["weights"][bucket], len(texts)) + model["bias"]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, predicted."""
    own = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for first, last, part in _texts(batch["text"]):
                value = np.round(1 / (1 + np.exp(-np.clip(logits(part, own.value), -30, 30))), 9)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, last - first), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
