"""Graphs as edge tables: connected components, ancestor chains."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder in local sessions without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/brindle"


def store(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again, which ends its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/brindle-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reached) of every node of ``links`` (a, b).

    Labels spread to neighbours and then to their labels' labels (pointer jumping), so the
    rounds grow with the logarithm of the longest path."""
    edges = store(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    label = store(edges.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        near = edges.join(label.select(F.col("node").alias("b"), F.col("root").alias("seen")), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        step = label.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("further"))
        after = store(step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("further", "root")).alias("root")))
        label = after.select("node", "root")
        if after.filter("root <> old").isEmpty():
            return label


def ancestor_chains(nodes: DataFrame, max_depth: int) -> DataFrame:
    """id and its chain of ids from the root, for nodes (id, parent) whose chain ends at a
    node without parent within ``max_depth`` steps; cycles and missing parents drop out."""
    parents = nodes.select(F.col("id").alias("up"), F.col("parent").alias("next"))
    open_chain = nodes.select("id", F.col("parent").alias("at"), F.array("id").alias("chain"))
    found = open_chain.filter("at is null").select("id", "chain")
    for _ in range(max_depth):
        open_chain = open_chain.filter("at is not null").join(parents, F.col("at") == F.col("up"))
        open_chain = open_chain.filter(~F.array_contains("chain", F.col("up"))).select("id", F.col("next").alias("at"), F.concat(F.array("up"), "chain").alias("chain"))
        found = found.unionByName(open_chain.filter("at is null").select("id", "chain"))
    return found


def passing_depths(nodes: DataFrame) -> DataFrame:
    """id and depth (1 at a root) of the nodes (id, parent, passes) that pass and all of whose
    ancestors pass, whatever the depth; nodes under a cycle or a missing parent drop out.

    Each round doubles how far a node has looked up, so the rounds grow with the logarithm of
    the deepest chain; a cycle never ends at a root, and is told by rounds that end none."""
    own = nodes.select("id", F.col("parent").alias("at"), F.lit(1).cast("long").alias("depth"), "passes")
    own = store(own.filter("passes").select("id", "at", "depth"))
    while True:
        open_ones = own.filter("at is not null")
        up = own.select(F.col("id").alias("at"), F.col("at").alias("further"), F.col("depth").alias("more"))
        after = store(own.filter("at is null").unionByName(open_ones.join(up, "at").select("id", F.col("further").alias("at"), (F.col("depth") + F.col("more")).alias("depth"))))
        left = after.filter("at is not null").count()
        if not left or (left == open_ones.count() and after.filter("at is null").count() == own.filter("at is null").count()):
            return after.filter("at is null").select("id", "depth")
        own = after
