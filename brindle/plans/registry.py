"""Queries by name, each beside the SQL that another engine can check it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated query under its own name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


#: Bytes that Spark reads in one task by default.
SPLIT_BYTES = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a table of less than one split for each core is dealt out over all
    cores first (a shuffle of at most one split a core), a larger one is read as it lies."""
    rows = table(spark, sf_dir, "documents")
    cores, files = spark.sparkContext.defaultParallelism, rows.inputFiles()
    if not 0 < len(files) < cores:
        return rows
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] or 0
    return rows.repartition(cores) if size < cores * SPLIT_BYTES else rows
