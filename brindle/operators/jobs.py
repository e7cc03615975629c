"""Running jobs: cancelling them from outside, plans by name, plans of plans."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Cancelled(Exception):
    """The job was asked to stop before it was done."""


def cancellable(spark: SparkSession, job: Callable, cancelled: Callable[[], bool], every: float = 0.2):
    """The result of ``job()``; if ``cancelled()`` becomes true, its Spark jobs are cancelled.

    Jobs are named by a tag, so that no other job of the session is touched."""
    tag, done, stopped = f"brindle-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        while not done.wait(every):
            if cancelled():
                stopped.set()
                spark.sparkContext.cancelJobsWithTag(tag)

    if cancelled():
        raise Cancelled
    spark.sparkContext.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        return job()
    except (PySparkException, Exception) as error:
        if stopped.is_set():
            raise Cancelled from error
        raise
    finally:
        done.set()
        watcher.join()
        spark.sparkContext.removeJobTag(tag)


def prepare(plans: dict[str, Callable], name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the plan of that name; an unknown name is an error that lists them."""
    if name not in plans:
        raise KeyError(f"no plan {name!r}; there are {', '.join(sorted(plans))}")
    return plans[name](spark, sf_dir)


def staged(plans: dict[str, Callable], parts: dict[str, str], spark: SparkSession, sf_dir: str) -> DataFrame:
    """part and id of several plans, each giving the named column as its ids."""
    made = [prepare(plans, name, spark, sf_dir).select(F.lit(name).alias("part"), F.col(column).cast("long").alias("id")).distinct() for name, column in parts.items()]
    return reduce(DataFrame.unionByName, made)
