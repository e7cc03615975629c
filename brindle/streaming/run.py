"""Running streams: what is there once, or batch by batch until the source is exhausted."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from brindle.streaming.source import EXHAUSTED, numbered

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _settings(spark: SparkSession, tasks: int | None, idle: bool):
    """Settings that a query takes with it when it starts: state in RocksDB, of which a batch
    stores the changes; ``tasks`` of stateful operators (fixed by the first run of a
    checkpoint); ``idle``: batches without rows may follow, in which windows close and timers
    fire."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower(),
    }
    if tasks is not None:
        wanted["spark.sql.shuffle.partitions"] = str(tasks)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_once(stream: DataFrame, path: str, checkpoint: str, tasks: int | None = None) -> DataFrame:
    """Process what is there, append it to ``path``, and read all of it; windows that have ended
    and timers follow in a batch without rows."""
    with _settings(stream.sparkSession, tasks, True):
        running = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drain(stream: DataFrame, path: str, checkpoint: str, batches: int | None = None, tasks: int | None = None) -> bool:
    """Append what the stream brings to ``path`` until its source is exhausted, or stop once
    ``batches`` are committed; whether it was exhausted."""
    with _settings(stream.sparkSession, tasks, False):
        running = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
    while running.isActive and (batches is None or len(numbered(f"{checkpoint}/commits")) < batches):
        time.sleep(0.05)
    running.stop()
    error = running.exception()
    if error is not None and EXHAUSTED not in str(error):
        raise error
    return error is not None
