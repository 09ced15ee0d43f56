"""Distances between all points, block against block: ranges, silhouettes, diameters, agreement of distances.

Points are dealt into blocks of about SIZE; each unordered pair of blocks is one row that numpy takes at once, so a task holds
two blocks however many points there are. What comes out is already summed for each point of either block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import squared_distance
from ..functions.storage import cut

SIZE = 1024


#: Most ranges of distance to the pivot; bounds what the driver sees of them.
RANGES = 4096


#: One in so many pairs of blocks meets at first, where what is left to ask may then be asked of all.
FIRST = 8


def ranged(points: DataFrame) -> DataFrame:
    """points (id, v, ...) with r, the distance to a pivot, which is the mean of all points, and its range."""
    n = max(1, -(-points.count() // SIZE))
    mean = [r["m"] for r in points.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m")).orderBy("d").collect()]
    seen = cut(points.withColumn("r", F.sqrt(squared_distance(F.col("v"), F.lit([float(x) for x in mean])))), "pivot")
    k = min(n, RANGES)
    ends = sorted(set(seen.approxQuantile("r", [i / k for i in range(1, k)], 0.1 / k))) if k > 1 else []
    return seen.withColumn("range", F.size(F.filter(F.lit(ends), lambda e: e <= F.col("r"))) if ends else F.lit(0))


def _groups(counts: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """A group for each key (twice a range, and 1 more where it is asked), and each group's points: neighbouring ranges with few
    points are one group, apart for asked ones and others."""
    groups, sizes = {}, {}
    for odd in (0, 1):
        at = None
        for k in sorted(k for k in counts if k % 2 == odd):
            if at is None or sizes[at] + counts[k] > 1.5 * SIZE:
                at, sizes[k] = k, 0
            groups[k] = at
            sizes[at] += counts[k]
    return groups, sizes


def block_pairs(points: DataFrame, columns: dict[str, Column], reach: float | None = None, asked: Column | None = None) -> DataFrame:
    """a_<name> and b_<name> for every pair of blocks, once: a_block <= b_block. Vectors are laid end to end.

    With `reach`, only pairs of blocks that can hold points of `v` so near to each other: blocks are ranges of the distance to
    a pivot (see `ranged`, which points may have passed already), and two points are at least as far apart as their distances to
    any pivot differ. A range with too many points, as of copies, is dealt into several blocks.

    With `asked`, points for which it holds get blocks of their own, a_asked and b_asked tell them, and only pairs with such a
    block come."""
    if reach is not None and "range" not in points.columns:
        points = ranged(points)
    place = ["r", "range"] if reach is not None else [F.lit(0.0).alias("r"), F.lit(0).alias("range")]
    named = points.select("id", *place, (F.lit(True) if asked is None else asked).alias("asked"), *[c.alias(k) for k, c in columns.items()])
    vector = {f.name: f.dataType.typeName() == "array" for f in named.schema}
    key = (F.col("range") * 2 + F.col("asked").cast("int")).alias("key")
    counts = {r["key"]: r["count"] for r in named.groupBy(key).count().collect()}
    groups, sizes = _groups(counts)
    look = lambda of, at: F.element_at(F.create_map(*[F.lit(x) for k in of for x in (k, of[k])]), at) if of else F.lit(1)
    dealt = named.withColumn("group", look(groups, key)).withColumn("part", F.pmod(F.xxhash64("id"), look({g: -(-m // SIZE) for g, m in sizes.items()}, F.col("group"))).cast("int"))
    rows = dealt.groupBy("group", "part", "asked").agg(F.collect_list(F.struct("id", *columns)).alias("rows"), F.min("r").alias("low"), F.max("r").alias("high"))
    lay = lambda c: F.transform("rows", lambda r: r[c])
    block = (F.col("group").cast("long") * (1 << 31) + F.col("part")).alias("block")
    flat = cut(rows.select(block, "low", "high", "asked", *[(F.flatten(lay(c)) if vector[c] else lay(c)).alias(c) for c in ("id", *columns)]), "blocks")
    side = lambda p: flat.select(*[F.col(c).alias(f"{p}_{c}") for c in flat.columns])
    near = F.col("a_block") <= F.col("b_block")
    if asked is not None:
        near &= F.col("a_asked") | F.col("b_asked")
    if reach is not None:
        near &= F.col("b_low") - F.col("a_high") <= reach * (1 + 1e-9) + 1e-9
    return side("a").join(side("b"), near).drop("a_low", "a_high", "b_low", "b_high")


def first_pairs(points: DataFrame, columns: dict[str, Column], reach: float) -> DataFrame:
    """Of `block_pairs`, blocks with themselves and one in FIRST of the others, as a hash picks them."""
    return block_pairs(points, columns, reach).filter((F.col("a_block") == F.col("b_block")) | (F.pmod(F.xxhash64("a_block", "b_block"), F.lit(FIRST)) == 0))


def _both_ways(r) -> list[tuple]:
    """The pair of blocks as seen from each of its ends; a block with itself is seen once."""
    return [("a", "b", False), ("b", "a", True)] if r.a_block != r.b_block else [("a", "b", False)]


def _product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """n x m squared distances by a matrix product, and the sizes beside which they may be wrong by rounding."""
    x, y = (a * a).sum(axis=1), (b * b).sum(axis=1)
    d2 = (-2 * a) @ b.T
    d2 += x[:, None]
    d2 += y
    most = max(x.max(initial=0), y.max(initial=0))
    even = most <= 4 * min(x.min(initial=most), y.min(initial=most))
    return d2, float(2 * most) if even else np.add.outer(x, y)


def _differences(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of a[i] and b[j], which are 0 for equal points."""
    step = max(1, (1 << 21) // max(1, a.shape[1]))
    parts = [((b[j[k : k + step]] - a[i[k : k + step]]) ** 2).sum(axis=1) for k in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """n x m squared distances, by a matrix product but for near points, whose product cancels."""
    d2, scale = _product(a, b)
    i, j = np.nonzero(~(d2 >= 1e-3 * scale))
    d2[i, j] = _differences(a, b, i, j)
    return d2


def within_each(a: np.ndarray, b: np.ndarray, epsilons: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of points at most so far apart, for each of epsilons, as differences have it: those that the product may
    put on the wrong side are done again."""
    d2, scale = _product(a, b)
    most, slack = max(epsilons), 1e-15 * (a.shape[1] + 8) * scale
    i, j = np.nonzero(~(d2 > most * most * (1 + 1e-12) + slack))
    d2 = d2[i, j]
    off = (slack if np.isscalar(slack) else slack[i, j]) + 0.0
    doubt = np.zeros(len(i), bool)
    for eps in epsilons:
        doubt |= ~(np.abs(d2 - eps * eps) > off + 1e-12 * eps * eps)
    d2[doubt] = _differences(a, b, i[doubt], j[doubt])
    d = np.sqrt(np.maximum(d2, 0))
    return [(i[d <= eps], j[d <= eps]) for eps in epsilons]


def matrix(flat: np.ndarray, n: int) -> np.ndarray:
    return np.asarray(flat, float).reshape(n, -1)


def distances(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m Euclidean distances of vectors laid end to end; equal points are at 0."""
    return np.sqrt(squared_distances(matrix(a, n), matrix(b, m)))


def within(points: DataFrame, eps: float) -> DataFrame:
    """i, j, d: all ordered pairs at most eps apart, each point with itself among them."""

    def near(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                x, y = matrix(r.a_v, len(r.a_id)), matrix(r.b_v, len(r.b_id))
                ((i, j),) = within_each(x, y, [eps])
                a, b, d = np.asarray(r.a_id)[i], np.asarray(r.b_id)[j], np.sqrt(_differences(x, y, i, j))
                yield pd.DataFrame({"i": a, "j": b, "d": d})
                if r.a_block != r.b_block:
                    yield pd.DataFrame({"i": b, "j": a, "d": d})

    rows = points.select("id", F.col("v").cast("array<double>").alias("v"))
    return block_pairs(rows, {"v": F.col("v")}, eps if eps < float("inf") else None).mapInPandas(near, "i long, j long, d double")


def cluster_distances(points: DataFrame) -> DataFrame:
    """id, own, cluster, total, n, most: for each point (id, v, cluster) and each cluster, the sum, number and greatest of
    its distances to that cluster's points."""

    def sums(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                d = distances(r.a_v, r.b_v, len(r.a_id), len(r.b_id))
                for one, two, turned in _both_ways(r):
                    seen, to = (d.T if turned else d), np.asarray(getattr(r, f"{two}_cluster"))
                    order = np.argsort(to, kind="stable")
                    names, first, count = np.unique(to[order], return_index=True, return_counts=True)
                    ids, own, seen = np.asarray(getattr(r, f"{one}_id")), np.asarray(getattr(r, f"{one}_cluster")), seen[:, order]
                    total, most = np.add.reduceat(seen, first, axis=1).ravel(), np.maximum.reduceat(seen, first, axis=1).ravel()
                    k = len(names)
                    yield pd.DataFrame({"id": ids.repeat(k), "own": own.repeat(k), "cluster": np.tile(names, len(ids)), "total": total, "n": np.tile(count, len(ids)), "most": most})

    schema = "id long, own int, cluster int, total double, n long, most double"
    parts = block_pairs(points, {"v": F.col("v").cast("array<double>"), "cluster": F.col("cluster").cast("int")}).mapInPandas(sums, schema)
    return parts.groupBy("id", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("most").alias("most"))


def silhouettes(points: DataFrame) -> DataFrame:
    """id, s: (b - a) / max(a, b), 0 for a point alone in its cluster and where there is one cluster."""
    own = F.col("own") == F.col("cluster")
    sides = cluster_distances(points).groupBy("id").agg(F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    most = F.greatest("a", "b")
    return sides.select("id", F.when(most > 0, F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), (F.col("b") - F.col("a")) / most).otherwise(0.0)).otherwise(0.0).alias("s"))


def diameters(points: DataFrame) -> DataFrame:
    """cluster, diameter: the greatest distance within each cluster, 0 for one point."""
    return cluster_distances(points).filter("own = cluster").groupBy("cluster").agg(F.max("most").alias("diameter"))


def centroids(points: DataFrame) -> DataFrame:
    """cluster, centre."""
    means = points.select("cluster", F.posexplode(F.col("v").cast("array<double>")).alias("d", "x")).groupBy("cluster", "d").agg(F.avg("x").alias("m"))
    return means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("centre"))


def davies_bouldin(points: DataFrame) -> DataFrame:
    """index: the mean over clusters of the worst (scatter + scatter) / distance of centres. Pairs are of clusters only;
    clusters whose centres coincide make no pair."""
    centre = cut(centroids(points), "centroids")
    spread = points.join(centre, "cluster").groupBy("cluster").agg(F.avg(F.sqrt(squared_distance(F.col("v"), F.col("centre")))).alias("s"))
    c = spread.join(centre, "cluster")
    other = c.select(F.col("cluster").alias("k"), F.col("s").alias("t"), F.col("centre").alias("other"))
    gap = F.sqrt(squared_distance(F.col("centre"), F.col("other")))
    ratio = F.when(gap > 0, (F.col("s") + F.col("t")) / gap)
    worst = c.join(other, F.col("cluster") != F.col("k")).groupBy("cluster").agg(F.max(ratio).alias("r"))
    return worst.agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("index"))


def distance_correlation(points: DataFrame) -> DataFrame:
    """r: Pearson's correlation, over all ordered pairs of points and each with itself, of distances by v and by w."""

    def sums(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                n, m = len(r.a_id), len(r.b_id)
                x, y = distances(r.a_v, r.b_v, n, m), distances(r.a_w, r.b_w, n, m)
                times = 1 if r.a_block == r.b_block else 2  # each unordered pair of blocks stands for two
                yield pd.DataFrame([[times * z for z in (n * m, x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum())]], columns=["n", "x", "y", "xx", "yy", "xy"])

    parts = block_pairs(points, {c: F.col(c).cast("array<double>") for c in "vw"}).mapInPandas(sums, "n double, x double, y double, xx double, yy double, xy double")
    t = parts.agg(*[F.sum(c).alias(c) for c in parts.columns])
    spread = F.sqrt((F.col("n") * F.col("xx") - F.col("x") ** 2) * (F.col("n") * F.col("yy") - F.col("y") ** 2))
    return t.select(F.when(spread > 0, (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / spread).otherwise(0.0).alias("r"))
