"""Quality classifier: a factorisation machine.

Features of a text: its distinct hashed words (each 1 / sqrt(how many)), and structure
statistics in equal steps (length, word length, capitals, digits, marks, repeated words and
lines, line length), each a one-hot bucket.  Metadata: how far the ``n_chars`` column is
from the text's length.  With x the features, the logit is

    bias + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

the pairwise interactions of rank ``RANK`` in linear time.

The driver gets the features of the sampled rows as two-byte numbers, at most ``WORD_BUCKETS``
+ ``STATISTICS`` of a text however long it is: 262 MB for ``TRAIN_ROWS`` texts with every word.

Cases: null and empty texts have only their statistics; very long texts are read whole; null
``n_chars`` has a bucket of its own; several labels of a document count by their mean (good
from 0.5, ties included); without labels of both kinds the score is the share of good labels
(0.5 without any); repeated rows are scored alike; an empty table gives no rows; other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.textvec import IS_WORD, U, Words, slices, utf8
from brindle.llm.toxicity import labelled

WORD_BUCKETS = 1 << 14
LEVELS = 16
STATISTICS = 12
FEATURES = WORD_BUCKETS + STATISTICS * LEVELS
RANK = 8
#: Bound of the labelled rows that are fitted (chosen by a hash of the id).
TRAIN_ROWS = 8_000
#: Steps of the fit and rows of a step, at every number of labelled rows.
STEPS, STEP_ROWS = 400, 256
SEED = 4


def statistics(raw: np.ndarray, at: np.ndarray, n_chars: np.ndarray, words: Words) -> np.ndarray:
    """Documents x STATISTICS, each value in 0 to LEVELS - 1."""
    n = len(at) - 1

    def share(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[at[1:]] - total[at[:-1]]) / np.maximum(of, 1)

    size = np.diff(at)
    chars = size - share((raw & 0xC0) == 0x80, np.ones(n)).astype(np.int64)
    count = np.diff(words.first)
    upper = share((raw >= 65) & (raw <= 90), size)
    digit = share((raw >= 48) & (raw <= 57), size)
    low = words.low
    mark = share(~IS_WORD[low] & (raw > 32), size)
    odd = share(np.isin(raw, np.frombuffer(b"#$%&*@^_|~<>{}[]\\/", np.uint8)), size)
    shout = share(np.isin(raw, np.frombuffer(b"!?", np.uint8)), size)
    stop = share(raw == 46, np.maximum(count, 1))
    line = share(raw == 10, np.ones(n)) + 1
    word_chars = np.bincount(words.doc, words.end - words.start, n) / np.maximum(count, 1)
    pair = np.unique(words.doc.astype(U) * U(0x9E3779B97F4A7C15) ^ words.hash, return_index=True)[1]
    variety = np.bincount(words.doc[pair], minlength=n) / np.maximum(np.sqrt(count * 20.0), 1)
    same = np.zeros(len(words.hash), dtype=bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    again = np.bincount(words.doc[same], minlength=n) / np.maximum(count, 1)
    gap = np.where(np.isnan(n_chars), 1.0, np.minimum(np.abs(np.nan_to_num(n_chars) - chars) / np.maximum(chars, 1), 0.9))
    scaled = [
        np.log2(count + 1) / 16, upper * 1.2, np.sqrt(digit), np.sqrt(mark * 2), np.sqrt(odd * 4), np.sqrt(shout * 4),
        np.minimum(stop, 1), word_chars / 16, np.minimum(variety, 2) / 2, np.sqrt(again), np.log2(count / line + 1) / 10, gap,
    ]
    return np.clip((np.stack(scaled, 1) * LEVELS).astype(np.int64), 0, LEVELS - 1)


def features(raw: np.ndarray, at: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, feature and value, by document."""
    n = len(at) - 1
    words = Words(raw, at)
    pair = np.unique(words.doc * WORD_BUCKETS + (words.hash >> U(50)).astype(np.int64))
    doc, item = pair // WORD_BUCKETS, pair % WORD_BUCKETS
    level = statistics(raw, at, n_chars, words) + WORD_BUCKETS + np.arange(STATISTICS) * LEVELS
    doc = np.concatenate([doc, np.repeat(np.arange(n), STATISTICS)])
    order = np.argsort(doc, kind="stable")
    doc, item = doc[order], np.concatenate([item, level.ravel()])[order]
    return doc, item, values(item, np.bincount(doc, minlength=n)[doc])


def values(item: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The value of each feature of a text that has ``of`` features: words and statistics
    each have a square sum of 1."""
    return (1 / np.sqrt(np.where(item < WORD_BUCKETS, of - STATISTICS, STATISTICS))).astype(np.float32)


def logits(doc: np.ndarray, item: np.ndarray, value: np.ndarray, n: int, model: dict) -> np.ndarray:
    """By the sum-of-squares identity; every document has at least its statistics."""
    start = np.searchsorted(doc, np.arange(n))
    linear = np.add.reduceat(model["w"][item] * value, start)
    spread = model["v"][item] * value[:, None]
    summed = np.add.reduceat(spread, start)
    squares = np.add.reduceat(spread * spread, start)
    return model["bias"] + linear + 0.5 * (summed * summed - squares).sum(axis=1)


def _arrays(batch: pa.RecordBatch):
    raw, at = utf8(batch["text"])
    chars = batch["n_chars"].to_numpy(zero_copy_only=False).astype(np.float64)
    for first, last, part, offsets in slices(raw, at):
        yield first, last, features(part, offsets, chars[first:last])


def _lists(batches):
    for batch in batches:
        for first, last, (doc, item, _) in _arrays(batch):
            bounds = pa.array(np.searchsorted(doc, np.arange(last - first + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["label"].slice(first, last - first), pa.ListArray.from_arrays(bounds, pa.array(item, pa.int16()))], ["label", "items"])


def fit(y: np.ndarray, at: np.ndarray, item: np.ndarray, value: np.ndarray, steps: int = STEPS, rank: int = RANK) -> dict:
    """``steps`` steps of Adam on the logistic loss, classes weighted alike, in a fixed order of
    batches; the rows are gone through as often as that takes."""
    random = np.random.default_rng(SEED)
    model = {"w": np.zeros(FEATURES, np.float32), "v": random.normal(0, 0.05, (FEATURES, rank)).astype(np.float32), "bias": 0.0}
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return {"w": model["w"], "v": np.zeros_like(model["v"]), "bias": float(np.log(share / (1 - share)))}
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    state = {k: (np.zeros_like(model[k]), np.zeros_like(model[k])) for k in ("w", "v")}
    bias_state, turn, size = [0.0, 0.0], 0, STEP_ROWS
    while turn < steps:
        order = random.permutation(len(y))
        for low in range(0, min(len(y), (steps - turn) * size), size):
            rows = order[low : low + size]
            count = at[rows + 1] - at[rows]
            doc = np.repeat(np.arange(len(rows)), count)
            spot = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[rows], count)
            i, x = item[spot], value[spot]
            start = np.cumsum(count) - count
            spread = model["v"][i] * x[:, None]
            summed = np.add.reduceat(spread, start)
            z = model["bias"] + np.add.reduceat(model["w"][i] * x, start) + 0.5 * (summed * summed - np.add.reduceat(spread * spread, start)).sum(axis=1)
            error = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            own = (error[doc] * x).astype(np.float32)
            used, back = np.unique(i, return_inverse=True)
            gw = np.bincount(back, own, len(used)) + 1e-5 * model["w"][used]
            gv_rows = own[:, None] * (summed[doc] - spread)
            gv = np.stack([np.bincount(back, gv_rows[:, f], len(used)) for f in range(gv_rows.shape[1])], 1) + 1e-4 * model["v"][used]
            turn += 1
            for name, g in (("w", gw), ("v", gv)):
                m, s = state[name]
                m[used] = 0.9 * m[used] + 0.1 * g
                s[used] = 0.999 * s[used] + 0.001 * g * g
                model[name][used] -= 0.02 * (m[used] / (1 - 0.9**turn)) / (np.sqrt(s[used] / (1 - 0.999**turn)) + 1e-8)
            g = float(error.sum())
            bias_state = [0.9 * bias_state[0] + 0.1 * g, 0.999 * bias_state[1] + 0.001 * g * g]
            model["bias"] -= 0.02 * (bias_state[0] / (1 - 0.9**turn)) / (np.sqrt(bias_state[1] / (1 - 0.999**turn)) + 1e-8)
    return model


def _with_chars(docs: DataFrame) -> list:
    chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return [F.col("doc_id").cast("long").alias("doc_id"), "text", chars.alias("n_chars")]


def train(docs: DataFrame, labels: DataFrame, teaches=None, bound: int = TRAIN_ROWS) -> dict:
    """The model, from ``labels.quality`` of the label rows that ``teaches`` (a condition)
    holds for, about ``bound`` documents at most."""
    chosen = labelled(docs, labels, "quality", teaches, bound, SEED).select("doc_id", "label").distinct()
    rows = docs.select(_with_chars(docs)).join(F.broadcast(chosen), "doc_id").select("text", "n_chars", "label")
    got = rows.mapInArrow(_lists, "label int, items array<smallint>").toArrow()
    items = got["items"].combine_chunks()
    y, bounds, flat = got["label"].to_numpy().astype(np.float64), items.offsets.to_numpy(), items.values.to_numpy()
    order = sorted(range(len(y)), key=lambda k: (y[k], bounds[k + 1] - bounds[k], flat[bounds[k] : bounds[k + 1]].tobytes()))
    size = np.array([bounds[k + 1] - bounds[k] for k in order], np.int64)
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    pick = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in order]) if order else np.zeros(0, np.int64)
    item = flat[pick]
    return fit(y[order] if order else y, at, item, values(item, np.repeat(size, size)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, predicted."""
    own = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for first, last, (doc, item, value) in _arrays(batch):
                z = logits(doc, item, value, last - first, own.value)
                p = np.round(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))), 6)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, last - first), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(_with_chars(docs)).mapInArrow(run, "doc_id long, score double, predicted int")
