"""Deduplication, exclusion, ranking, quotas and interleaving."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from brindle.functions import runs
from brindle.operators.graph import store
from brindle.operators.packing import offsets


def first_by_key(rows: DataFrame, key: str, *order) -> DataFrame:
    """Of rows with one key, the first in order.

    A grouped minimum (with map-side combine) instead of a window: a hot key costs one row
    per task in the shuffle."""
    keep = F.struct(*[o.alias(f"order{i}") for i, o in enumerate(order)], *[F.col(c) for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.min(keep).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rows.columns if c != key])


def grams_of(rows: DataFrame, id_column: str, text: str, n: int, *more: str, among: Broadcast | None = None) -> DataFrame:
    """id (and ``more`` columns) and each distinct hashed n-word run of the normalised text; of a
    bit table ``among``, only the runs whose bit is set."""
    own = rows.select(id_column, *more, F.lower(F.col(text)).alias("gram"))

    def run(batches):
        for batch in batches:
            for low, high in runs.pieces(batch.column(batch.num_columns - 1)):
                part = batch.slice(low, high - low)
                row, gram = runs.hashed(part.column(part.num_columns - 1), n, among.value if among is not None else None)
                yield pa.RecordBatch.from_arrays([*[c.take(row) for c in part.columns[:-1]], gram], batch.schema.names)

    return own.mapInArrow(run, StructType([*own.schema.fields[:-1], StructField("gram", LongType())]))


def bits_of(grams: DataFrame) -> np.ndarray:
    """A bit table of hashed runs, 2 MB whatever their number."""
    place = F.shiftrightunsigned("gram", 64 - runs.BITS)
    words = grams.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - runs.BITS}) & 63 as int))")).alias("bits"))
    table = np.zeros(1 << (runs.BITS - 6), np.int64)
    for r in words.toLocalIterator():
        table[r["at"]] = r["bits"]
    return table.view(np.uint64)


def overlapping(rows: DataFrame, id_column: str, others: DataFrame, text: str = "text", n: int = 13) -> DataFrame:
    """ids of rows that share an n-word run with any text of ``others``.

    A bit table of their runs of bounded size drops most other runs where they are made; the
    join decides, however many bits are set."""
    wanted = store(grams_of(others, others.columns[0], text, n).select("gram").distinct())
    among = rows.sparkSession.sparkContext.broadcast(bits_of(wanted))
    return grams_of(rows, id_column, text, n, among=among).join(wanted, "gram", "left_semi").select(id_column).distinct()


def exclude(rows: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    return rows.join(ids, id_column, "left_anti")


def sequential_holdout(rows: DataFrame, id_column: str, split: str, order: list[str], n: int) -> DataFrame:
    """Rows of later splits that share no n-word run with rows kept in earlier splits.

    Texts are read once: their hashed runs are written beside id and split, and every later
    step joins these."""
    grams = store(grams_of(rows, id_column, "text", n, split))
    held, dropped = grams.filter(F.col(split) == order[0]).select("gram"), []
    for name in order[1:]:
        own = grams.filter(F.col(split) == name)
        bad = store(own.join(held.distinct(), "gram", "left_semi").select(id_column).distinct())
        dropped.append(bad)
        held = held.union(own.join(bad, id_column, "left_anti").select("gram"))
    kept = rows.filter(F.col(split).isin(*order))
    for bad in dropped:
        kept = exclude(kept, bad, id_column)
    return kept


def set_digest(rows: DataFrame, key: str, *groups: str) -> DataFrame:
    """groups, n and an order-free digest of their keys (hexadecimal), repeats included.

    Copies of a key are counted first; the keys of each of 65,536 ranges (by their first four
    digits) make a digest, and these the group's: no row holds more than one range's keys or
    all ranges' digests."""
    counted = rows.groupBy(*groups, key).agg(F.count("*").alias("n"))
    own = F.array_join(F.array_sort(F.collect_list(F.concat_ws("x", key, F.col("n").cast("string")))), ",")
    ranges = counted.groupBy(*groups, F.substring(key, 1, 4).alias("head")).agg(F.sha2(own, 256).alias("digest"), F.sum("n").alias("n"))
    named = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "head", "digest"))), ",")
    return ranges.groupBy(*groups).agg(F.sha2(named, 256).alias("digest"), F.sum("n").alias("n"))


def set_digest_sql(rows: str, key: str, *groups: str) -> str:
    """The same of a table, for SQL text."""
    by = ", ".join(groups) + ", " if groups else ""
    return f"""select {by}sha256(string_agg(head || ':' || digest, ',' order by head || ':' || digest)) as digest, cast(sum(n) as bigint) as n from (select {by}substr(key, 1, 4) as head, sha256(string_agg(key || 'x' || n, ',' order by key || 'x' || n)) as digest, sum(n) as n
 from (select {by}{key} as key, count(*) as n from {rows} group by all) group by all) {'group by ' + ', '.join(groups) if groups else ''}"""


def hash_rank(seed: str, id_column: Column) -> Column:
    return F.sha2(F.concat(F.lit(seed + ":"), id_column.cast("string")), 256)


def top_by_hash(rows: DataFrame, k: int, seed: str, id_column: str, *strata: str) -> DataFrame:
    """The k rows of each stratum with the smallest seeded hash; a per-task limit comes
    before the shuffle (WindowGroupLimit)."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("hash", id_column))
    return rows.withColumn("hash", hash_rank(seed, F.col(id_column))).withColumn("rank", rank).filter(F.col("rank") <= k)


def quotas(sources: DataFrame, total: int) -> DataFrame:
    """label, quota: the floor of each share by weight, the rest to the first in order."""
    whole = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    floor = F.expr(f"{total} * weight div sum_weight")
    rows = sources.withColumn("sum_weight", F.sum("weight").over(whole)).withColumn("floor", floor)
    rows = rows.withColumn("rest", F.lit(total) - F.sum("floor").over(whole)).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ord")))
    return rows.select("label", (F.col("floor") + F.when(F.col("place") <= F.col("rest"), 1).otherwise(0)).cast("long").alias("quota"))


def budget_cut(rows: DataFrame, size: str, target: int, order: list, *strata: str) -> DataFrame:
    """Rows in order until their sizes reach the target; the row that reaches it is taken."""
    return offsets(rows, order, size, *strata).withColumnRenamed("start", "before").filter(F.col("before") < target)


def places(rows: DataFrame, order: list, *strata: str) -> DataFrame:
    """``place`` of each row in its stratum, from 0."""
    return offsets(rows.withColumn("one", F.lit(1).cast("long")), order, "one", *strata).drop("one").withColumnRenamed("start", "place")


def first_places(rows: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows in order with their ``place``, from 0: each task keeps its own first k,
    and no other row is moved."""
    return rows.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long") - 1)


def weighted_interleave(rows: DataFrame, source: str, weight: str, ord_column: str, *order) -> DataFrame:
    """Rows numbered as if the source with the least (rows taken / weight) always came
    next: in closed form, by index / weight, then source order."""
    placed = places(rows, list(order), source).withColumnRenamed("place", "index")
    return placed.withColumn("position", F.col("index") / F.col(weight)).withColumn("turn_key", F.struct("position", ord_column))


def fractional_interleave(rows: DataFrame, source: str, *order) -> DataFrame:
    """position = (i + 1/2) / n of each row within its source."""
    n = store(rows.groupBy(F.col(source).alias("own_source")).agg(F.count("*").alias("n")))
    placed = places(rows, list(order), source).join(n, F.col(source).eqNullSafe(F.col("own_source")))
    return placed.withColumn("position", (F.col("place") + 0.5) / F.col("n")).drop("place", "own_source", "n")


def round_robin(rows: DataFrame, stratum: str, *order) -> DataFrame:
    """``round`` (from 1) of each row in its stratum, and ``turn``: its place when strata take
    turns, in their order, round after round."""
    rounds = places(rows, list(order), stratum).withColumn("round", F.col("place") + 1).drop("place")
    return places(rounds, ["round", stratum]).withColumnRenamed("place", "turn")


def batches(rows: DataFrame, source: str, quota: Column, *order) -> DataFrame:
    """batch = which fixed-composition batch a row falls in, by its source's quota."""
    return places(rows, list(order), source).withColumn("batch", F.floor(F.col("place") / quota).cast("long")).drop("place")


def cycle(rows: DataFrame, id_column: str, epochs: int, seed: str) -> DataFrame:
    """Every row once per epoch, each epoch in an order of its own (column ``hash``)."""
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return each.withColumn("hash", F.sha2(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.col(id_column).cast("string")), 256))


def leaks(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split, with the numbers of splits and rows."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("n")).filter("splits > 1")


def family_exposures(rows: DataFrame, exposures: int, seed: str, batch: int = 4) -> DataFrame:
    """turn, family, id: families take turns; each gives its rows in hash order, over again when
    they end, and passes over a row whose group the batch already has.

    ``rows`` has id, grp and families.  Every choice depends on those before it, so there is one
    owner; it needs no more than the ``exposures`` first rows of each family, which bounds it."""
    each = rows.select("id", "grp", F.explode("families").alias("family")).withColumn("h", F.sha2(F.concat_ws(":", F.lit(seed), "family", F.col("id").cast("string")), 256))
    first = each.withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy("h"))).filter(F.col("place") <= exposures)

    def run(frame):
        pools = {name: list(zip(own["id"], own["grp"], strict=True)) for name, own in frame.sort_values(["family", "place"]).groupby("family")}
        names, at, out, groups = sorted(pools), dict.fromkeys(pools, 0), [], []
        for turn in range(exposures if names else 0):
            name = names[turn % len(names)]
            groups = groups if turn % batch else []
            for _ in pools[name]:
                chosen, grp = pools[name][at[name] % len(pools[name])]
                at[name] += 1
                if grp not in groups:
                    break
            else:
                raise ValueError(f"every row of {name} shares a group with its batch")
            groups.append(grp)
            out.append((turn, name, chosen))
        return pd.DataFrame(out, columns=["turn", "family", "id"])

    return first.select("family", "id", "grp", "place").groupBy(F.lit(0).alias("owner")).applyInPandas(lambda key, frame: run(frame), "turn long, family string, id long")
