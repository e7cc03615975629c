"""Metrics over evaluation records: intervals, tests, schedules, folds."""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Fixed value: the 97.5 % point of the normal distribution.
Z95 = 1.959963984540054


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % score interval of a share; null for none."""
    p, z2 = hits / n, Z95 * Z95
    scale = 1 + z2 / n
    middle = (p + z2 / (2 * n)) / scale
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / scale
    return F.when(n > 0, middle - half), F.when(n > 0, middle + half)


def first_max(values: Column) -> Column:
    """Index from 0 of the greatest value; of equal ones the first."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def per_character(scores: Column, characters: Column) -> Column:
    """Log-likelihoods divided by the characters of their choices."""
    return F.zip_with(scores, characters, lambda s, n: s / n)


def loosened(text: Column) -> Column:
    """A text, the same without its first line, and without its last."""
    return F.array(text, F.regexp_replace(text, r"\A[^\n]*\n?", ""), F.regexp_replace(text, r"\n?[^\n]*\z", ""))


def followed(flags: DataFrame) -> DataFrame:
    """mode and its counts and accuracies by prompt and by instruction, from rows with an array
    of flags for each mode (``strict``, ``loose``)."""
    each = flags.select(F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("flags")) for m in ("strict", "loose")])))
    all_of, some = F.forall("flags", lambda x: x), F.size(F.filter("flags", lambda x: x))
    return each.groupBy("mode").agg(
        F.count("*").alias("prompts"), F.count_if(all_of).alias("prompts_followed"), F.sum(F.size("flags")).alias("instructions"), F.sum(some).alias("followed"),
        F.round(F.avg(all_of.cast("int")), 6).alias("prompt_accuracy"), F.round(F.sum(some) / F.sum(F.size("flags")), 6).alias("instruction_accuracy"),
    )


def gated(gates: DataFrame, *keys: str) -> DataFrame:
    """Whether every metric (metric, value, least) of a key reaches its least, and which fail."""
    low = F.col("value") < F.col("least")
    return gates.groupBy(*keys).agg((~F.bool_or(low)).alias("passes"), F.count_if(low).alias("failed"), F.array_join(F.array_sort(F.collect_list(F.when(low, F.col("metric")))), ",").alias("reasons"))


def mcnemar(counts: DataFrame) -> DataFrame:
    """Rows with gained and lost, and the exact two-sided p of their difference."""

    def p_value(gained: int, lost: int) -> float:
        n = gained + lost
        if not n:
            return 1.0
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(min(gained, lost) + 1)]
        return min(1.0, 2 * math.fsum(map(math.exp, logs)))

    def run(frames):
        for frame in frames:
            yield frame.assign(p=[p_value(int(g), int(x)) for g, x in zip(frame["gained"], frame["lost"], strict=True)])

    return counts.mapInPandas(run, StructType([*counts.schema.fields, StructField("p", DoubleType())]))


def poisson_steps(bits: int = 16) -> list[int]:
    """Least numbers of ``bits`` bits that mean one, two and more of a Poisson variable of mean
    1 by its inverse distribution function."""
    out, mass, total = [], math.exp(-1), 0.0
    for k in range(1, 99):
        total += mass
        step = math.floor(total * (1 << bits))
        if step >= (1 << bits) - 1:
            break
        out.append(step)
        mass /= k
    return out


#: Draws that one digest of 64 hexadecimal digits has, and digits of each.
PER_DIGEST, DIGITS = 16, 4
#: Rows whose weights are looked up together.
BLOCK_ROWS = 1024


def _weigh(draws: int, seed: str):
    """For tasks: sums of the weights and of the weighed values of every draw."""
    digests = -(-draws // PER_DIGEST)
    table = np.searchsorted(poisson_steps(), np.arange(1 << 16), side="right").astype(np.float64)
    heads = [f"{seed}:{d}:".encode() for d in range(digests)]

    def run(batches):
        total = np.zeros((2, digests * PER_DIGEST))
        for batch in batches:
            keys, values = [k.encode() for k in batch["key"].to_pylist()], batch["x"].to_numpy(zero_copy_only=False)
            for low in range(0, len(keys), BLOCK_ROWS):
                own = keys[low : low + BLOCK_ROWS]
                raw = b"".join([sha256(head + k).digest() for k in own for head in heads])
                weights = table[np.frombuffer(raw, ">u2").astype(np.uint16)].reshape(len(own), -1)
                total += np.stack([np.ones(len(own)), values[low : low + BLOCK_ROWS]]) @ weights
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(total[0, :draws]), pa.array(total[1, :draws])], ["draw", "w", "x"])

    return run


def bootstrap(rows: DataFrame, column: str, key: str, draws: int = 1000, seed: str = "bootstrap") -> DataFrame:
    """Number and mean of a column's values and the 2.5 and 97.5 % points of its bootstrapped mean.

    In each draw a row counts as often as a Poisson variable of mean 1 says, which is read off
    the hash of draw and key: any engine finds the same weights, and no row is gathered.  Tasks
    add up the weights of all draws, block by block, before a shuffle of a row a draw and task."""
    each = rows.select(F.col(key).cast("string").alias("key"), F.col(column).cast("double").alias("x")).filter("x is not null and key is not null")
    sums = shared_out(each).mapInArrow(_weigh(draws, seed), "draw long, w double, x double").groupBy("draw").agg(F.sum("w").alias("w"), F.sum("x").alias("x"))
    means = sums.filter("w > 0").select((F.col("x") / F.col("w")).alias("mean"))
    points = means.agg(*[F.percentile("mean", F.lit(q)).alias(name) for q, name in ((0.025, "low"), (0.975, "high"))])
    whole = rows.filter(F.col(column).isNotNull()).agg(F.count("*").alias("n"), F.avg(column).alias("delta"))
    return whole.filter("n > 0").join(points)


def shared_out(rows: DataFrame) -> DataFrame:
    """Keys and values dealt out over all cores: a row costs far more than its way there."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def learning_rate(progress: Column, peak: float, warm: float, hold: float, floor: float) -> Column:
    """Linear warm-up, a plateau, then half a cosine down to ``floor`` of the peak."""
    down = floor + (1 - floor) * (1 + F.cos(F.lit(math.pi) * (progress - hold) / (1 - hold))) / 2
    return peak * F.when(progress < warm, progress / warm).when(progress < hold, 1.0).otherwise(down)


def event_due(before: Column, after: Column, interval: int) -> Column:
    return F.floor(before / interval) != F.floor(after / interval)


def plateau(losses: Column, initial: float, floor: float, factor: float, patience: int, cooldown: int, min_delta: float) -> Column:
    """The rate cap after each loss of an ordered array, as an array of struct(loss, cap,
    action): the cap falls when ``patience`` losses in a row bring no improvement."""
    start = F.struct(F.lit(initial).alias("cap"), F.lit(math.inf).alias("best"), F.lit(0).alias("bad"), F.lit(cooldown).alias("cool"), F.array().cast("array<struct<loss:double,cap:double,action:string>>").alias("out"))

    def step(s: Column, loss: Column) -> Column:
        better = loss < s["best"] - min_delta
        cooling, at_floor = s["cool"] > 0, s["cap"] <= floor
        late = s["bad"] + 1 >= patience
        action = F.when(cooling, "cooldown").when(better, "improved").when(at_floor, "at-floor").when(late, "reduced").otherwise("monitoring")
        cap = F.when(action == "reduced", F.greatest(F.lit(floor), s["cap"] * factor)).otherwise(s["cap"])
        return F.struct(
            cap.alias("cap"), F.when(better, loss).otherwise(s["best"]).alias("best"), F.when(action == "monitoring", s["bad"] + 1).otherwise(0).alias("bad"),
            F.when(cooling, s["cool"] - 1).when(action == "reduced", cooldown).otherwise(0).alias("cool"),
            F.concat(s["out"], F.array(F.struct(loss.alias("loss"), cap.alias("cap"), action.alias("action")))).alias("out"),
        )

    return F.aggregate(losses, start, step, lambda s: s["out"])


def plateau_fold(initial: float, floor: float, factor: float, patience: int, cooldown: int, min_delta: float):
    """``plateau`` for a whole series (event_type, event_id, value) of any length, in linear
    time: a function for applyInArrow, which gives event_type, i, loss, cap, act."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("event_id")
        losses, caps, acts = group["value"].to_pylist(), [], []
        cap, best, bad, cool = initial, math.inf, 0, cooldown
        for loss in losses:
            better = loss is not None and loss < best - min_delta
            act = "cooldown" if cool > 0 else "improved" if better else "at-floor" if cap <= floor else "reduced" if bad + 1 >= patience else "monitoring"
            cap = max(floor, cap * factor) if act == "reduced" else cap
            best = loss if better else best
            bad = bad + 1 if act == "monitoring" else 0
            cool = cool - 1 if cool > 0 else cooldown if act == "reduced" else 0
            caps.append(cap)
            acts.append(act)
        n = len(losses)
        return pa.table({"event_type": group["event_type"], "i": pa.array(range(1, n + 1), pa.int32()), "loss": group["value"], "cap": pa.array(caps, pa.float64()), "act": pa.array(acts, pa.string())})

    return run
