"""Scalar, table and aggregate functions under names of their own, for SQL text.

``brindle_sketch`` of 60-bit hashes, ``brindle_merge`` of sketches and ``brindle_distinct`` of
one count different values in bounded memory: a sketch has the ``SKETCH`` smallest different
hashes of a group, so the sketch of a union is the smallest of all of them, in whatever order
groups are merged.  Up to ``SKETCH`` values are counted exactly; of more, the place of the
largest hash kept gives the number with a relative standard error of 1 / sqrt(SKETCH - 2).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from brindle.functions.text import _compose

#: Hashes in a sketch, and the number of hashes there may be.
SKETCH, HASHES = 1024, 1 << 60

#: Name, parameters, result and body of the functions that SQL itself can say.
SCALARS = (
    ("brindle_norm", "value STRING", "STRING", "trim(regexp_replace(lower(value), '[^a-z0-9]+', ' '))"),
    ("brindle_key", "value STRING", "STRING", r"sha2(trim(regexp_replace(brindle_compose(value), '[\\s\\x1c-\\x1f\\x85\\p{Z}]+', ' ')), 256)"),
    ("brindle_bucket", "key STRING, modulus INT", "INT", "cast(((cast(conv(substring(key, 1, 8), 16, 10) as bigint) % modulus) * (4294967296 % modulus) + cast(conv(substring(key, 9, 8), 16, 10) as bigint)) % modulus as int)"),
    ("brindle_split", "key STRING", "STRING", "case when brindle_bucket(key, 10000) < 100 then 'final' when brindle_bucket(key, 10000) < 200 then 'validation' when brindle_bucket(key, 10000) < 300 then 'tokenizer_dev' else 'train' end"),
    ("brindle_words", "value STRING", "ARRAY<STRING>", "filter(split(brindle_norm(value), ' '), w -> w <> '')"),
    ("brindle_hash", "value STRING", "BIGINT", "cast(conv(substring(md5(value), 1, 15), 16, 10) as bigint)"),
)
#: Every run of n words of a text, with its place from 0.
GRAMS = """select cast(place as int) as place, array_join(slice(w, place + 1, n), ' ') as gram
 from (select brindle_words(value) as w) lateral view explode(case when size(w) >= n then sequence(0, size(w) - n) else array() end) g as place"""


def smallest(hashes: np.ndarray) -> bytes:
    """The sketch of some hashes."""
    found = np.unique(hashes)
    return found[:SKETCH].astype("<i8").tobytes()


def estimate(sketch: bytes | None) -> int:
    """Different values behind a sketch."""
    kept = np.frombuffer(sketch or b"", "<i8")
    return len(kept) if len(kept) < SKETCH else (SKETCH - 1) * HASHES // int(kept[-1])


@F.pandas_udf(BinaryType())
def sketch(hashes: pd.Series) -> bytes:
    return smallest(hashes.dropna().to_numpy(dtype=np.int64))


@F.pandas_udf(BinaryType())
def merge(sketches: pd.Series) -> bytes:
    return smallest(np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(s, "<i8") for s in sketches.dropna()]]))


@F.pandas_udf(LongType())
def distinct(sketches: pd.Series) -> pd.Series:
    return sketches.map(estimate).astype("int64")


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql``."""
    spark.udf.register("brindle_compose", _compose)
    for name, f in (("brindle_sketch", sketch), ("brindle_merge", merge), ("brindle_distinct", distinct)):
        spark.udf.register(name, f)
    for name, parameters, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION brindle_grams(value STRING, n INT) RETURNS TABLE(place INT, gram STRING) RETURN {GRAMS}")
