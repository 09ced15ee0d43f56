"""k-means with many settings at once: each step is one pass over the points for all of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut, drop_cut
from .pairwise import diameters


def inertia(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """inertia: the sum over points of the squared distance to the nearest centre."""
    from .stats import nearest

    return nearest(points, centres).agg(F.coalesce(F.sum("d2"), F.lit(0.0)).alias("inertia"))


def seeded_starts(points: DataFrame, k: int, seed: int) -> list[list[float]]:
    """k points, the first by a hash of id and seed."""
    return [[float(x) for x in r["v"]] for r in points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).collect()]


#: Points of a block that a task takes at once.
BLOCK = 4096


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, the first of equal ones, and the squared distance to it. Where the matrix product can't
    tell the nearest from the next, differences do."""
    scale = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)
    d2 = scale - 2 * (x @ centres.T)
    at = d2.argmin(axis=1)
    rows = np.arange(len(x))
    least = d2[rows, at]
    close = ~(d2 > (least + 1e-15 * (x.shape[1] + 8) * scale.max(axis=1))[:, None])
    for i in np.nonzero(close.sum(axis=1) != 1)[0]:
        at[i] = ((x[i] - centres) ** 2).sum(axis=1).argmin()
    return at, ((x - centres[at]) ** 2).sum(axis=1)


def lloyd_many(points: DataFrame, starts: list[list[list[float]]], rounds: int = 300) -> list[tuple[list[list[float]], float]]:
    """(centres, inertia) of k-means from each list of starting centres; a list is done when its centres stand still, and an
    empty cluster keeps its centre. Points are written once as blocks; each round is one job, whose tasks, a few for each core,
    send one array for all lists that still move."""
    found, live = [np.array(s, float) for s in starts], set(range(len(starts)))
    if not found:
        return []

    def pack(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                column = batch.column(0)[k : k + BLOCK]
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(column)], pa.int32()), "x": pa.array([column.flatten().to_numpy(zero_copy_only=False).astype(float).tobytes()], pa.binary())})

    spark = points.sparkSession
    written = cut(points.select(F.col("v").cast("array<double>").alias("v")).mapInArrow(pack, "n int, x binary"), "blocks")
    table = written.coalesce(4 * spark.sparkContext.defaultParallelism)

    def passed(which: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
        now = {k: found[k] for k in which}

        def sums(batches):
            out = {k: np.zeros((len(c), c.shape[1] + 2)) for k, c in now.items()}  # sums, number, cost
            for batch in batches:
                for n, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    x = np.frombuffer(blob.as_buffer()).reshape(n, -1)
                    for k, c in now.items():
                        at, d2 = _nearest(x, c)
                        hot = np.zeros((len(c), n))
                        hot[at, np.arange(n)] = 1
                        out[k][:, :-2] += hot @ x
                        out[k][:, -2] += hot.sum(axis=1)
                        out[k][:, -1] += hot @ d2
            yield pa.RecordBatch.from_pydict({"s": pa.array([np.concatenate([o.ravel() for o in out.values()]).tobytes()], pa.binary())})

        total = sum((np.frombuffer(r["s"]) for r in table.mapInArrow(sums, "s binary").collect()), np.zeros(sum(c.size + 2 * len(c) for c in now.values())))
        parts, at = {}, 0
        for k, c in now.items():
            part = total[at : at + c.size + 2 * len(c)].reshape(len(c), -1)
            at += part.size
            parts[k] = part[:, :-2], part[:, -2], float(part[:, -1].sum())
        return parts

    for _ in range(rounds):
        if not live:
            break
        for k, (s, n, _) in passed(sorted(live)).items():
            new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], found[k])
            if np.allclose(new, found[k]):
                live.remove(k)
            else:
                found[k] = new
    costs = {k: cost for k, (_, _, cost) in passed(list(range(len(found)))).items()}
    drop_cut(written)
    return [(c.tolist(), costs[k]) for k, c in enumerate(found)]


def sweep(points: DataFrame, ks: list[int], seeds: list[int], rounds: int = 300) -> DataFrame:
    """k, seed, inertia for every number of clusters and seed of the starts: the elbow over k, the stability over seeds."""
    settings = [(k, s) for k in ks for s in seeds]
    got = lloyd_many(points, [seeded_starts(points, k, s) for k, s in settings], rounds)
    return points.sparkSession.createDataFrame([(k, s, cost) for (k, s), (_, cost) in zip(settings, got, strict=True)], "k int, seed int, inertia double")


def mean_diameter(points: DataFrame) -> DataFrame:
    """mean_diameter: over the clusters of (id, v, cluster), of the greatest distance within each."""
    return diameters(points).agg(F.avg("diameter").alias("mean_diameter"))
