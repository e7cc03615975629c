"""Sharding by jump consistent hashing.

The shard of a row depends on its ``doc_id`` and the number of shards alone; with one more
shard, a row stays or moves into the new one.  Rows are numbered within their shard, by
``doc_id``: they are sorted by range over all partitions, numbered where they are, and
moved up by the counts of the partitions before.  No shard is ever gathered in one task.

Cases: null ``doc_id`` counts as key -1 and comes first; null text has size 1 and the
checksum of an empty text; very long texts are measured whole; rows that repeat a ``doc_id``
(ties) get slots of their own; an empty table gives no rows; other columns, whatever their
names, aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import shared
from brindle.llm.textvec import U

SHARDS = 8
_ROW = (1 << 33) - 1


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every 64-bit key: the last bucket below ``shards`` that its random
    jumps reach."""
    state = keys.astype(np.int64).view(U).copy()
    here, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        here[live] = ahead[live]
        state[live] = state[live] * U(2862933555777941757) + U(1)
        draw = ((state[live] >> U(33)) + U(1)).astype(np.float64)
        ahead[live] = ((here[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return here


def _jumps(shards: int):
    def run(batches):
        for batch in batches:
            keys = batch["doc_id"].fill_null(-1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["size"], batch["text_crc32"], pa.array(jump(keys, shards), pa.int32()), pa.array(jump(keys, shards + 1), pa.int32())],
                ["doc_id", "size", "text_crc32", "shard", "grown_shard"],
            )

    return run


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes and 1), text_crc32, law, shard,
    slot (from 0 without gaps in each shard) and grown_shard (with one more shard)."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.mapInArrow(_jumps(shards), "doc_id long, size long, text_crc32 long, shard int, grown_shard int")
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("shard", "doc_id", "tie").sortWithinPartitions("shard", "doc_id", "tie")
    here = shared.materialize(dealt.withColumn("spot", F.monotonically_increasing_id()).drop("tie"), "sharded")
    here = here.withColumns({"part": F.shiftright("spot", 33), "row": F.col("spot").bitwiseAND(F.lit(_ROW))})
    counts = here.groupBy("shard", "part").agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # At most shards * partitions rows: bounded by the settings.
    shift = counts.select("shard", "part", (before - F.col("first")).alias("shift"))
    return here.join(F.broadcast(shift), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("row") + F.col("shift")).alias("slot"), "grown_shard"
    )
