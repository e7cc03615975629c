"""The corpus pipeline: language, exact copies, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; stages but the last return
the columns of ``documents``.  Every stage's rows are written and read again by the next.

Cases: null and empty texts, and texts whose predicted language doesn't stand out from
chance, go in the first stage; very long texts are read whole in every stage; repeated rows
and copies (ties) keep the smallest ``doc_id``, and of rows equal in both one; rows with null
``doc_id`` stay unless a copy of theirs does; an empty table gives an empty result; other
columns, whatever their names, pass through to the last stage, which returns doc_id,
n_tokens, ids_sha256 and decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import bpe, decontaminate, exact_dedup, language, near_dedup
from brindle.llm.queries import documents, vocabulary_path
from brindle.llm.shared import materialize, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, language.train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, vocabulary_path())


STAGES = [
    ("language", known_language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontaminate", benchmark_leaks),
    ("bpe", tokens),
]

#: Language prediction, sketches and byte-pair merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
