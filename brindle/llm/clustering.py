"""Ball k-means: exact rounds of k-means that compare a vector with neighbour clusters only.

A cluster is a ball: its centroid and a radius that covers its members (the farthest member's
distance to the former centroid plus the way that the centroid moved).  Another cluster can
take members of it only if half the distance of the two centroids is within the radius: these
are its neighbours, sorted by that distance.  A member nearer to its centroid than half the
way to the nearest neighbour is in the stable core and stays; the others lie in annuli, and
one in the k-th annulus is compared with the k nearest neighbours.  A ball that didn't move
and whose neighbours didn't is settled: its members keep cluster and distance unread.

All arithmetic is on whole numbers, so the result is that of comparing every vector with
every centroid.  The vectors are quantised once and written with their cluster each round
(``spark.checkpoint.dir``; the former round's table is deleted then); a round brings the
sums of each task and cluster to the last aggregate and those of ``k`` clusters to the driver.

Cases: vectors that are null, of another length, or with a null or non-finite component go;
repeated rows count as often as they occur; equal distances go to the smaller number; equal
ids among the first centroids are ordered by their components, a null id hashes as ``2:``;
fewer vectors than ``k`` make fewer clusters, none an empty result; components beyond
``limit(dims)`` after scaling (2**26 for 64, where squares would leave 64 bits) count as
that limit; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import discard, store

K = 40
ROUNDS = 5
DIMS = 64
SCALE = 256
SEED = "2"


def limit(dims: int) -> int:
    """Largest component with which four times a squared distance stays below 2**63."""
    return 1 << ((59 - (dims - 1).bit_length()) // 2)


@dataclass
class Balls:
    """Centroids and, by cluster, the neighbours in the order of their distance."""

    centers: np.ndarray
    near: list[np.ndarray] | None = None
    #: Squared distances to them.
    apart: list[np.ndarray] | None = None
    settled: np.ndarray | None = None


def around(centers: np.ndarray, radius: np.ndarray, moved: np.ndarray) -> Balls:
    """The balls with their neighbours; ``radius`` may be too large, never too small."""
    near, apart = [], []
    settled = ~moved
    for i, own in enumerate(centers):
        square = ((centers - own) ** 2).sum(axis=1)
        reach = np.flatnonzero(square <= (2 * radius[i]) ** 2 * (1 + 1e-9))
        reach = reach[reach != i]
        reach = reach[np.argsort(square[reach], kind="stable")]
        near.append(reach)
        apart.append(square[reach])
        settled[i] &= not moved[reach].any()
    return Balls(centers, near, apart, settled)


def squares(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row or to one centroid."""
    gap = rows - centers
    if gap.size and len(gap[0]) * int(np.abs(gap).max()) ** 2 < 1 << 53:
        gap = gap.astype(np.float64)
    return np.einsum("ij,ij->i", gap, gap).astype(np.int64)


def assign(rows: np.ndarray, own: np.ndarray, known: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each row; ``own`` and ``known`` are those of the last
    round (-1: none yet)."""
    own, best = own.copy(), known.copy()
    new = np.flatnonzero(own < 0)
    if len(new):
        own[new], best[new] = 0, squares(rows[new], balls.centers[0])
        for j in range(1, len(balls.centers)):
            other = squares(rows[new], balls.centers[j])
            less = other < best[new]
            own[new[less]], best[new[less]] = j, other[less]
    if balls.near is None:
        return own, best
    order = np.argsort(own, kind="stable")
    bounds = np.searchsorted(own[order], np.arange(len(balls.centers) + 1))
    for i, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if low == high or balls.settled[i]:
            continue
        members = order[low:high]
        here = squares(rows[members], balls.centers[i])
        annulus = np.searchsorted(balls.apart[i], 4 * here, side="right")
        winner = np.full(len(members), i)
        for k in range(annulus.max()):
            open_ = np.flatnonzero(annulus > k)
            j = balls.near[i][k]
            other = squares(rows[members[open_]], balls.centers[j])
            less = (other < here[open_]) | ((other == here[open_]) & (j < winner[open_]))
            here[open_[less]], winner[open_[less]] = other[less], j
        own[members], best[members] = winner, here
    return own, best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _assigner(balls, dims: int):
    def run(batches):
        for batch in batches:
            own, best = assign(_matrix(batch["v"], dims), batch["cluster"].to_numpy(), batch["distance"].to_numpy(), balls.value)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(own, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "v", "cluster", "distance"])

    return run


def _summer(k: int, dims: int):
    """Of each task and cluster: the sum of each component, and under -1 members, -2 distances,
    -3 the farthest member."""

    def run(batches):
        n, total, far, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            own, distance = batch["cluster"].to_numpy(), batch["distance"].to_numpy()
            n += np.bincount(own, minlength=k)
            np.maximum.at(far, own, distance)
            np.add.at(total, own, distance)
            rows, order = _matrix(batch["v"], dims), np.argsort(own, kind="stable")
            found, first = np.unique(own[order], return_index=True)
            if len(found):
                sums[found] += np.add.reduceat(rows[order], first, axis=0)
        there = np.flatnonzero(n)
        values = np.column_stack([n, total, far, sums])[there]
        places = np.tile(np.concatenate([[-1, -2, -3], np.arange(dims)]), len(there))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(there, dims + 3), pa.int32()), pa.array(places, pa.int32()), pa.array(values.ravel())], ["cluster", "place", "value"])

    return run


def quantised(vectors: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """vec_id and whole components ``v`` of the usable vectors, without a cluster."""
    x, most = F.col(vector), limit(dims)
    usable = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), c.cast("double") * scale)))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), x.alias(vector)).filter(usable)
    return rows.select("vec_id", F.transform(whole, lambda c: F.floor(c).cast("int")).alias("v"), F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))


def _sums(rows: DataFrame, k: int, dims: int) -> dict[int, dict[int, int]]:
    """What ``_summer`` found, over all tasks: k * (dims + 3) numbers."""
    parts = rows.mapInArrow(_summer(k, dims), "cluster int, place int, value long")
    found: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "place").agg(F.sum("value").alias("total"), F.max("value").alias("most")).collect():
        found.setdefault(r["cluster"], {})[r["place"]] = r["most"] if r["place"] == -3 else r["total"]
    return found


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """Two tables: vec_id, cluster, distance of every usable vector; and of every cluster its
    number, members, inertia and centroid (at most ``k`` rows)."""
    spark = vectors.sparkSession
    path = store(quantised(vectors, vec_id, vector, dims, scale), "vectors")
    rows = spark.read.parquet(path)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select("v", "vec_id").orderBy(drawn, "vec_id", "v").limit(k).collect()
    balls = Balls(np.array([r["v"] for r in first], np.int64).reshape(-1, dims))
    for turn in range(rounds + 1):
        own = rows.mapInArrow(_assigner(spark.sparkContext.broadcast(balls), dims), rows.schema)
        after = store(own, f"clusters-{turn}")
        discard(spark, path)
        path, rows = after, spark.read.schema(rows.schema).parquet(after)
        found = _sums(rows, len(balls.centers), dims)
        if turn == rounds:
            break
        centers, radius = balls.centers.copy(), np.zeros(len(first))
        for i, about in found.items():
            centers[i] = [about[j] // about[-1] for j in range(dims)]
            radius[i] = float(about[-3]) ** 0.5
        drift = ((centers - balls.centers).astype(np.float64) ** 2).sum(axis=1) ** 0.5
        balls = around(centers, radius + drift, drift > 0)
    none = {-1: 0, -2: 0}
    table = [(i, found.get(i, none)[-1], found.get(i, none)[-2], own.tolist()) for i, own in enumerate(balls.centers)]
    return rows.select("vec_id", "cluster", "distance"), spark.createDataFrame(table, "cluster int, n long, inertia long, centroid array<long>")


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def report(vectors: DataFrame, **options) -> DataFrame:
    """Every vector with its cluster's and the whole inertia and its centroid's digest."""
    rows, balls = cluster(vectors, **options)
    known = balls.collect()  # k rows
    total = sum(r["inertia"] for r in known)
    lines = [(r["cluster"], r["inertia"], total, centroid_digest(r["centroid"])) for r in known]
    about = rows.sparkSession.createDataFrame(lines, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
