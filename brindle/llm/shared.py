"""Storage and table helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: list[str] = []


#: Bytes that Spark reads in one task by default.
SPLIT_BYTES = 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows as they are read, but a table with less than one split for each core is dealt
    out over all cores first (a shuffle of at most one split a core)."""
    spark = rows.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, rows.inputFiles()
    if not 0 < len(files) < cores:
        return rows
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] or 0
    return rows.repartition(cores) if size < cores * SPLIT_BYTES else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster session gets
    an error, as its executors could not see one another's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="brindle-"))
    return f"file://{_LOCAL_DIR[0]}"


def store(df: DataFrame, label: str) -> str:
    """Write ``df`` as Parquet in the shared folder; the path of it."""
    path = f"{shared_dir(df.sparkSession)}/brindle-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here.

    A lost executor then costs a reread, and values that depend on row placement
    (row numbers, partition numbers) are fixed for all later uses.
    """
    return df.sparkSession.read.schema(df.schema).parquet(store(df, label))


def discard(spark: SparkSession, path: str) -> None:
    """Delete what ``store`` wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> int:
    """Delete all tables of this package in the shared folder, once the results that read them
    are stored; how many there were."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/brindle-*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    for status in found:
        discard(spark, status.getPath().toString())
    return len(found)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(rows: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows chosen by a hash of ``key``; all rows if there are no more.

    Used only to fit models: the bound is a parameter of each operator.
    """
    n = rows.count()
    if n <= bound:
        return rows
    return rows.filter(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 1) < int(bound / n * (1 << 63)))


def held_out(doc_id: str, modulus: int, remainder: int):
    """True where crc32(doc_id as text) mod ``modulus`` is ``remainder``; null id: of ''."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")
    return F.pmod(F.crc32(text), F.lit(modulus)) == remainder
