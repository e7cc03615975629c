"""Exact deduplication by deterministic block naming.

A text, its white space normalised, is cut into blocks of ``BLOCK_BYTES``.  Blocks are
dealt by content, sorted, and every distinct block gets an integer name; then adjacent
names of a document are paired and every distinct pair gets a name, again and again, until
one name stands for the whole document.  Equal (level, name) means equal text, without any
hash that could collide.

Hot texts: rows are first gathered inside each input batch, and what is written has a local
number for each distinct block of a batch, with the list of its rows.  Blocks alone travel
to be named, each with its local number, once a batch however many copies there are; names
come back by local number, which no two lists share, so a hot block's rows are never in one
task.  Groups are counted with map-side sums.

Cases: null text counts as empty; all empty texts are equal; very long texts are many
blocks; null ``doc_id`` comes after every other; rows that repeat a ``doc_id`` are still
separate rows, and of rows equal in text and ``doc_id`` (ties) one alone is marked as kept;
an empty table has no groups; other columns are kept by ``keep_first`` whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import shared
from brindle.llm.textvec import slices, utf8

BLOCK_BYTES = 8192
GATHER_BYTES = 16 << 20

MEMBER = "uid long, doc_id long, place int, blocks int, sha string"


def normalise(raw: bytes) -> bytes:
    """Every run of space, tab, line feed, vertical tab, form feed or return as one space."""
    body = b" ".join(raw.split())
    if not raw:
        return body
    lead, tail = raw[:1].isspace(), raw[-1:].isspace()
    return b" " if not body else b" " * lead + body + b" " * tail


def _gather(batches):
    """Blocks of a batch, each once, with a number of its own and the rows and places that
    hold it."""
    count = TaskContext.get().partitionId() << 36
    for batch in batches:
        uids, ids = batch["uid"].to_pylist(), batch["doc_id"].to_pylist()
        raw, at = utf8(batch["text"])
        for first, last, part, offsets in slices(raw, at, GATHER_BYTES):
            rows: dict[bytes, list[dict]] = {}
            data = part.tobytes()
            for k in range(last - first):
                text = normalise(data[offsets[k] : offsets[k + 1]])
                sha = hashlib.sha256(text).hexdigest()
                n = max(1, -(-len(text) // BLOCK_BYTES))
                for place in range(n):
                    rows.setdefault(text[place * BLOCK_BYTES : (place + 1) * BLOCK_BYTES], []).append(
                        {"uid": uids[first + k], "doc_id": ids[first + k], "place": place, "blocks": n, "sha": sha if place == 0 else None}
                    )
            kind = pa.struct([("uid", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int32()), ("blocks", pa.int32()), ("sha", pa.string())])
            local = pa.array(range(count, count + len(rows)), pa.int64())
            count += len(rows)
            yield pa.RecordBatch.from_arrays([local, pa.array(rows.keys(), pa.binary()), pa.array(rows.values(), pa.list_(kind))], ["local", "block", "members"])


def _name(batches):
    """Names of sorted blocks: partition number and rank."""
    base, rank, last = TaskContext.get().partitionId() << 36, -1, None
    for batch in batches:
        names = np.empty(batch.num_rows, np.int64)
        for i, block in enumerate(batch["block"].to_pylist()):
            if block != last:
                rank, last = rank + 1, block
            names[i] = base + rank
        yield pa.RecordBatch.from_arrays([batch["local"], pa.array(names)], ["local", "name"])


def identities(docs: DataFrame) -> DataFrame:
    """uid, doc_id, sha (of the normalised text), level and name, one row per row of ``docs``;
    equal (level, name) means equal normalised text."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    gathered = shared.materialize(rows.mapInArrow(_gather, f"local long, block binary, members array<struct<{MEMBER}>>"), "gathered")
    named = gathered.select("local", "block").repartition("block").sortWithinPartitions("block").mapInArrow(_name, "local long, name long")
    named = shared.materialize(named, "names")
    opened = gathered.select("local", "members").join(named, "local").select("name", F.explode("members").alias("m")).select("name", "m.*")
    whole = opened.filter("blocks = 1").select("uid", "doc_id", "sha", F.lit(0).alias("level"), "name")
    parts = opened.filter("blocks > 1").groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"),
    )
    done, level = [whole], 0
    parts = shared.materialize(parts, "level0")
    while not parts.isEmpty():
        level += 1
        parts = shared.materialize(_pair_up(parts), f"level{level}")
        done.append(parts.filter(F.size("names") == 1).select("uid", "doc_id", "sha", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        parts = parts.filter(F.size("names") > 1)
    return shared.union_all(done)


def _pair_up(parts: DataFrame) -> DataFrame:
    """The same rows, each with one name for every two adjacent names."""
    places = F.sequence(F.lit(0), (F.size("names") - 1).cast("int"), F.lit(2))
    pairs = parts.select("uid", "doc_id", "sha", F.explode(F.transform(places, lambda i: F.struct(i.alias("place"), F.get("names", i).alias("left"), F.coalesce(F.get("names", i + 1), F.lit(-1)).alias("right")))).alias("p"))
    pairs = pairs.select("uid", "doc_id", "sha", "p.*")
    names = pairs.groupBy("left", "right").agg(F.count("*").alias("uses")).sortWithinPartitions("left", "right").select("left", "right", F.monotonically_increasing_id().alias("name"))
    names = shared.materialize(names, "pairs")
    return pairs.join(names, ["left", "right"]).groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"),
    )


def decide(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = shared.materialize(identities(docs), "identity")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "uid")).alias("first")
    # Written, so that the join below deals out plain rows, which Spark can split where a group is hot.
    groups = shared.materialize(rows.groupBy("level", "name").agg(F.count("*").alias("group_size"), first).filter("group_size > 1"), "groups")
    joined = rows.join(groups, ["level", "name"], "left")
    single = F.col("group_size").isNull()
    return joined.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.when(single, True).otherwise(F.col("uid") == F.col("first.uid")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are found again by ``doc_id``; where one ``doc_id`` stands for several rows, those
    rows are told apart by their text, and of equal ones one stays.
    """
    decided = shared.materialize(decide(docs), "decided")
    per_id = decided.groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("rows"), F.count_if("kept").alias("stay")).filter("stay > 0")
    single = per_id.filter("rows = 1")
    out = docs.join(single, docs["doc_id"].cast("long") == single["kept_id"], "left_semi")
    mixed = per_id.filter("rows > 1 or kept_id is null")
    if mixed.isEmpty():
        return out
    sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)
    wanted = decided.filter("kept").select(F.col("doc_id").alias("__own_id"), F.col("text_sha256").alias("__own_sha"))
    wanted = wanted.join(mixed, F.col("__own_id").eqNullSafe(F.col("kept_id")), "left_semi")
    again = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__sha": sha}).join(wanted, F.col("__id").eqNullSafe(F.col("__own_id")) & (F.col("__sha") == F.col("__own_sha")), "left_semi")
    return out.unionByName(again.dropDuplicates(["__id", "__sha"]).drop("__id", "__sha"))
