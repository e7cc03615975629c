"""Token rows: concatenation of documents, cut into windows for next-token prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.graph import store


def offsets(rows: DataFrame, order, size: str, *strata: str) -> DataFrame:
    """``start``: the sum of the sizes before a row in order (in its stratum, if strata are
    named), without one task for all rows.

    Rows are dealt by ranges of the strata and the order, and written, so that their places
    hold for all that follows; sums of whole partitions (one row for each stratum of a
    partition) are added to sums inside partitions."""
    order = [order] if isinstance(order, str) else list(order)
    dealt = rows.repartitionByRange(*strata, *order).withColumn("part", F.spark_partition_id())
    dealt = store(dealt)
    keys = ["part", *strata]
    inside = F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    totals = dealt.groupBy(*keys).agg(F.sum(size).alias("total"))
    whole = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("total").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = store(totals.select(*keys, before.alias("shift")))
    same = [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in keys]
    placed = dealt.withColumn("inside", inside).join(shifts.select(*[F.col(k).alias(f"own_{k}") for k in keys], "shift"), same)
    return placed.withColumn("start", F.col("inside") + F.col("shift")).drop("part", "inside", "shift", *[f"own_{k}" for k in keys])


def pack(rows: DataFrame, order: str, tokens: str, length: int) -> DataFrame:
    """row_no, x, y: windows of ``length`` + 1 tokens at every multiple of ``length``; x is a
    window without its last token, y without its first.  An incomplete window is left out."""
    sized = offsets(rows.select(order, tokens, F.size(tokens).cast("long").alias("size")), order, "size")
    # A document's part of each window that it reaches into: one row a window, not one a token.
    first, last = F.floor((F.col("start") - 1) / length), F.floor((F.col("start") + F.col("size") - 1) / length)
    parts = sized.filter("size > 0").select("start", tokens, F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("row_no"))
    low = F.greatest(F.col("row_no") * length - F.col("start"), F.lit(0))
    high = F.least((F.col("row_no") + 1) * length + 1 - F.col("start"), F.size(tokens).cast("long"))
    piece = F.slice(tokens, (low + 1).cast("int"), (high - low).cast("int"))
    window = parts.filter(high > low).groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("start", piece.alias("piece")))).alias("p"))
    window = window.select("row_no", F.flatten(F.transform("p", lambda s: s["piece"])).alias("t")).filter(F.size("t") == length + 1)
    return window.select("row_no", F.slice("t", 1, length).alias("x"), F.slice("t", 2, length).alias("y"))
