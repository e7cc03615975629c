"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``DIMENSIONS`` signs, drawn from its code point.  A
three-letter run inside a word (with one space before and after the word) is bound to one
vector: its letters' vectors, rotated by their place, multiplied.  A document is the sum
(bundle) of its runs' vectors, a language's prototype the sum of its documents' unit
bundles, and a document gets the language whose prototype has the greatest cosine.

Bundles are sums of whole numbers, and prototypes and cosines are rounded before they are
compared, so a prediction doesn't depend on how rows are dealt out.

As a filter: a text stays if it has a language and its cosine is above that of unrelated
signs, whose standard deviation is 1 / sqrt(``DIMENSIONS``), by ``CHANCE`` deviations.

Cases: text without a letter, empty or null is ``und`` with score 0; if no row has a
language, every row is ``und``; very long texts are read whole; ties go to the language that
sorts first; rows whose ``lang`` is null don't teach; repeated rows are scored alike; an
empty table gives no rows; other columns, whatever their names, are kept by the filter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import shared
from brindle.llm.textvec import U, mix, slices, utf8

DIMENSIONS = 1024
#: Bound of the rows that teach (chosen by a hash of the id).
TRAIN_ROWS = 20_000
#: Standard deviations of chance that a text's cosine must exceed.
CHANCE = 3
DIGITS = 6
SEED = 7
UNKNOWN = "und"
SLICE_BYTES = 1 << 20

_IS_LETTER: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """By code point: whether it is a letter."""
    if not _IS_LETTER:
        _IS_LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _IS_LETTER[0]


def letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """A row of -1 and 1 for each code point."""
    words = -(-dimensions // 64)
    seeds = points.astype(U)[:, None] * U(0x9E3779B97F4A7C15) + np.arange(words, dtype=U)[None, :] * U(0xC2B2AE3D27D4EB4F)
    bits = np.unpackbits(mix(mix(seeds)).view(np.uint8), axis=1)[:, :dimensions]
    return (bits.astype(np.int8) * 2 - 1).astype(np.int8)


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points used (0 is the space), and by distinct (document, run): the document and
    the run as indexes into them, and its count."""
    lower = [t.lower() for t in texts]
    joined = "\n".join(["", *lower, ""])
    point = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter()[point]
    size = np.fromiter(map(len, lower), np.int64, len(lower)) + 1
    doc = np.concatenate([[0], np.repeat(np.arange(len(lower)), size)])
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    kept = np.flatnonzero(keep)
    used, code = np.unique(np.where(letter, point, 0)[kept], return_inverse=True)
    if used[0] != 0:
        used, code = np.concatenate([[0], used]), code + 1
    middle = np.flatnonzero(letter[kept])
    middle = middle[(middle > 0) & (middle < len(kept) - 1)]
    n = len(used)
    run = (code[middle - 1] * n + code[middle]) * n + code[middle + 1]
    pair, count = np.unique(doc[kept][middle] * n**3 + run, return_counts=True)
    return used, np.stack([pair // n**3, pair % n**3]), count


def bundles(texts: list[str], dimensions: int) -> np.ndarray:
    """One row per text: the sum of its runs' vectors."""
    used, pair, count = runs(texts)
    n = len(used)
    distinct, at = np.unique(pair[1], return_inverse=True)
    letters = letter_vectors(used, dimensions)
    out = np.zeros((len(texts), dimensions), np.float64)
    # Sums of whole numbers below 2**24 are exact in single precision, whatever their order.
    exact = np.float32 if np.bincount(pair[0], count, len(texts)).max(initial=0) < 1 << 24 else np.float64
    for low in range(0, len(distinct), 8192):
        some = distinct[low : low + 8192]
        bound = np.roll(letters, 2, 1)[some // (n * n)] * np.roll(letters, 1, 1)[some // n % n] * letters[some % n]
        here = (at >= low) & (at < low + len(some))
        counts = np.zeros((len(texts), len(some)), exact)
        counts[pair[0][here], at[here] - low] = count[here]
        out += counts @ bound.astype(exact)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def _parts(column: pa.Array):
    """Runs of rows of bounded text: first, last, texts."""
    for first, last, _, _ in slices(*utf8(column), SLICE_BYTES):
        for low in range(first, last, 1024):
            high = min(last, low + 1024)
            yield low, high, [t or "" for t in column.slice(low, high - low).to_pylist()]


def _sum_by_language(dimensions: int):
    def run(batches):
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), dtype=object)
            for first, last, texts in _parts(batch["text"]):
                unit = _unit(bundles(texts, dimensions))
                here = langs[first:last]
                names = sorted(set(here))
                sums = [unit[here == name].sum(axis=0, dtype=np.float64).tolist() for name in names]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sums, pa.list_(pa.float64()))], ["lang", "part"])

    return run


def train(docs: DataFrame, teaches=None, bound: int = TRAIN_ROWS, dimensions: int = DIMENSIONS) -> dict:
    """Prototypes by language, from the rows that ``teaches`` (a condition) holds for and
    whose ``lang`` isn't null, about ``bound`` of them at most."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.filter(teaches) if teaches is not None else rows
    rows = shared.bounded_sample(rows.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), "doc_id", bound, SEED)
    parts = rows.select("text", "lang").mapInArrow(_sum_by_language(dimensions), "lang string, part array<double>")
    sums = parts.select("lang", F.posexplode("part").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    table: dict[str, np.ndarray] = {}
    for r in sums.collect():
        table.setdefault(r["lang"], np.zeros(dimensions))[r["place"]] = r["value"]
    names = sorted(table)
    prototypes = _unit(np.array([table[x] for x in names], dtype=np.float64).reshape(len(names), dimensions))
    return {"langs": names, "prototypes": np.round(prototypes, DIGITS), "dimensions": dimensions}


def score(texts: list[str], model: dict) -> tuple[list[str], list[float]]:
    """Language and cosine (at least 0) of each text."""
    unit = _unit(bundles(texts, model["dimensions"]))
    if not model["langs"]:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    cosine = np.round(unit @ model["prototypes"].T, DIGITS)
    best = cosine.argmax(axis=1)
    empty = np.array([not any(map(str.isalpha, t)) for t in texts])
    value = np.clip(cosine[np.arange(len(texts)), best], 0, 1)
    langs = [UNKNOWN if none else model["langs"][k] for k, none in zip(best.tolist(), empty.tolist(), strict=True)]
    return langs, np.where(empty, 0.0, value).tolist()


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score."""
    own = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for first, last, texts in _parts(batch["text"]):
                langs, values = score(texts, own.value)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, last - first), pa.array(langs, pa.string()), pa.array(values, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: dict, chance: float = CHANCE) -> DataFrame:
    """The rows of ``docs``, all columns, whose prediction stands out from chance; if no
    language was taught, the rows that have a letter."""
    own = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for first, last, texts in _parts(batch["text"]):
                if own.value["langs"]:
                    known = stands_out(*score(texts, own.value), own.value["dimensions"], chance)
                else:
                    known = [any(map(str.isalpha, t)) for t in texts]
                yield batch.slice(first, last - first).filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def stands_out(langs: list[str], values: list[float], dimensions: int, chance: float = CHANCE) -> list[bool]:
    return [lang != UNKNOWN and value > chance / dimensions**0.5 for lang, value in zip(langs, values, strict=True)]
