"""Column statistics, regression by sums, ratings, clusters and evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import bind, cosine, sigmoid, squared_distance


def long_form(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, d, x: one row per entry."""
    return rows.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("d", "x"))


def column_stats(long: DataFrame) -> DataFrame:
    """d, mean, std (population), lowest, highest."""
    return long.groupBy("d").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("lowest"), F.max("x").alias("highest"))


def gram(long: DataFrame, key: str) -> DataFrame:
    """i, j, v: the entries of the transpose times the matrix."""
    a, b = long.select(key, F.col("d").alias("i"), F.col("x").alias("a")), long.select(key, F.col("d").alias("j"), F.col("x").alias("b"))
    return a.join(b, key).groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def covariance(rows: DataFrame, vector: str, width: int) -> np.ndarray:
    """Population covariance of a narrow matrix in two passes, means and then centred products; tasks send width^2 sums."""
    table = rows.select(F.col(vector).cast("array<double>").alias("v")).na.drop()

    def passed(of) -> np.ndarray:
        def sums(batches):
            total, n = 0.0, 0
            for batch in batches:
                x = np.array(batch["v"].tolist(), float).reshape(-1, width)
                total, n = total + of(x), n + len(x)
            if n:
                yield pd.DataFrame({"k": range(total.size + 1), "x": [*total.ravel(), n]})

        got = table.mapInPandas(sums, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()
        out = np.array([r["x"] for r in got])
        return out[:-1] / out[-1] if len(out) else np.zeros(of(np.zeros((0, width))).size)

    mean = passed(lambda x: x.sum(axis=0))
    return passed(lambda x: (x - mean).T @ (x - mean)).reshape(width, width)


def power_iteration(matrix: np.ndarray, most: int = 10_000, delta: float = 1e-6, seed: int = 42) -> tuple[float, np.ndarray]:
    """The dominant eigenpair of a symmetric matrix."""
    v = np.random.RandomState(seed).rand(len(matrix))
    v /= np.linalg.norm(v)
    for _ in range(most):
        new = matrix @ v
        size = np.linalg.norm(new)
        if size < 1e-12:
            break
        new /= size
        if np.linalg.norm(new - v) < delta:
            v = new
            break
        v = new
    return float(v @ matrix @ v), v


def eigenpairs(matrix: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """All pairs by deflation, greatest first."""
    left, out = matrix.copy(), []
    for _ in range(len(matrix)):
        value, v = power_iteration(left)
        out.append((value, v))
        left -= value * np.outer(v, v)
    return sorted(out, key=lambda p: -p[0])


def least_squares(rows: DataFrame, y: Column, xs: list[Column], ridge: float = 0.0) -> np.ndarray:
    """Intercept and weights of (ridge) regression with a free intercept, from one pass of sums."""
    x = [F.lit(1.0), *[c.cast("double") for c in xs]]
    n = len(x)
    sums = rows.agg(F.array(*[F.sum(x[i] * x[j]) for i in range(n) for j in range(i + 1)], *[F.sum(c * y.cast("double")) for c in x])).first()[0]
    a = np.zeros((n, n))
    a[np.tril_indices(n)] = sums[: n * (n + 1) // 2]
    a += np.tril(a, -1).T
    held = np.full(n, ridge)
    held[0] = 0
    return np.linalg.solve(a + np.diag(held), np.array(sums[n * (n + 1) // 2 :]))


def predicted(weights: np.ndarray, xs: list[Column]) -> Column:
    out = F.lit(float(weights[0]))
    for w, x in zip(weights[1:], xs, strict=True):
        out = out + F.lit(float(w)) * x.cast("double")
    return out


def polynomial(x: Column, degree: int) -> list[Column]:
    return [F.pow(x.cast("double"), F.lit(float(k))) for k in range(1, degree + 1)]


def gaussian(x: Column, centres: list[float], width: float) -> list[Column]:
    return [F.exp(-((x.cast("double") - c) * (x.cast("double") - c)) / (2 * width * width)) for c in centres]


def sigmoid_basis(x: Column, centres: list[float], width: float) -> list[Column]:
    return [sigmoid((x.cast("double") - c) / width) for c in centres]


def logistic_descent(rows: DataFrame, y: Column, xs: list[Column], rate: float = 1.0, rounds: int = 200) -> np.ndarray:
    """Batch gradient descent from zero; each round is one aggregate of the gradient's sums."""
    w = np.zeros(len(xs) + 1)
    for _ in range(rounds):
        gap = sigmoid(predicted(w, xs)) - y.cast("double")
        got = rows.agg(F.avg(gap), *[F.avg(gap * x.cast("double")) for x in xs]).first()
        w -= rate * np.array([float(g) for g in got])
    return w


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """label, precision, recall, f1 for each true label."""
    labels = rows.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("g"), (F.col(truth) == F.col(guess)).cast("int").alias("h")), F.struct(F.col(guess).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("g"), F.lit(0).alias("h")))).alias("s")).select("s.*")
    sums = labels.groupBy("label").agg(F.sum("t").alias("t"), F.sum("g").alias("g"), F.sum("h").alias("h"))
    p, r = F.when(F.col("g") > 0, F.col("h") / F.col("g")).otherwise(0.0), F.when(F.col("t") > 0, F.col("h") / F.col("t")).otherwise(0.0)
    return sums.select("label", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def biases(ratings: DataFrame) -> DataFrame:
    """user, item counts against the dense 0/1 table: kind, id, bias (row or column mean less the global mean)."""
    seen = ratings.select("user", "item").distinct()
    n, u, i = seen.agg(F.count(F.lit(1)), F.countDistinct("user"), F.countDistinct("item")).first()
    mean = n / (u * i) if n else 0.0
    of = lambda c, m: seen.groupBy(F.col(c).alias("id")).agg((F.count(F.lit(1)) / m - mean).alias("bias")).select(F.lit(c).alias("kind"), "id", "bias")
    return of("user", max(i, 1)).unionByName(of("item", max(u, 1)))


def user_based(ratings: DataFrame, user: int, most_item: int = 1000, near: int = 10, top: int = 5) -> DataFrame:
    """item, score: mean rating by the `near` users of greatest mean-centred cosine, items up to most_item."""
    centred = ratings.join(ratings.groupBy("user").agg(F.avg("rating").alias("mean")), "user").withColumn("c", F.col("rating") - F.col("mean"))
    norms = centred.groupBy("user").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm")).filter(F.col("norm") > 0)
    mine = centred.filter(F.col("user") == user).select("item", F.col("c").alias("m"))
    dots = centred.filter(F.col("user") != user).join(F.broadcast(mine), "item").groupBy("user").agg(F.sum(F.col("c") * F.col("m")).alias("dot"))
    others = dots.join(norms, "user").select("user", F.round(F.col("dot") / F.col("norm"), 9).alias("s")).orderBy(F.desc("s"), "user").limit(near)
    got = ratings.filter(F.col("item") <= most_item).join(F.broadcast(others), "user").groupBy("item").agg(F.round(F.avg("rating"), 6).alias("score"))
    return got.orderBy(F.desc("score"), "item").limit(top)


def farthest_first(points: DataFrame, k: int) -> list[tuple[int, list[float]]]:
    """k centres: the point of least id, then always the point farthest from its nearest centre (ties: least id)."""
    first = points.orderBy("id").first()
    centres = [(first["id"], [float(x) for x in first["v"]])]
    while len(centres) < k:
        d = F.least(*[squared_distance(F.col("v"), F.lit(c)) for _, c in centres]) if len(centres) > 1 else squared_distance(F.col("v"), F.lit(centres[0][1]))
        row = points.agg(F.max_by(F.struct("id", "v"), F.struct(F.round(d, 9), -F.col("id"))).alias("b")).first()["b"]
        centres.append((row["id"], [float(x) for x in row["v"]]))
    return centres


def nearest(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """id, v, cluster, d2: the nearest centre, the first of equal ones. Centres are few and fixed, so they are literals."""
    pairs = F.transform(F.lit([[float(x) for x in c] for c in centres]), lambda c, i: F.struct(squared_distance(F.col("v"), c).alias("d2"), i.alias("cluster")))
    return points.select("id", "v", bind(F.array_min(pairs), lambda b: b).alias("b")).select("id", "v", "b.cluster", "b.d2")


def lloyd(points: DataFrame, centres: list[list[float]], rounds: int = 20) -> list[list[float]]:
    """k-means steps until centres stand still; an empty cluster keeps its centre. Sums of k rows meet the driver."""
    for _ in range(rounds):
        long = nearest(points, centres).select("cluster", F.posexplode("v").alias("d", "x"))
        means: dict = {}
        for r in long.groupBy("cluster", "d").agg(F.avg(F.col("x").cast("double")).alias("m")).collect():
            means.setdefault(r["cluster"], {})[r["d"]] = r["m"]
        new = [[means[c][d] for d in range(len(old))] if c in means else old for c, old in enumerate(centres)]
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def cosine_top(points: DataFrame, target: list[float], k: int) -> DataFrame:
    return points.select("id", F.round(cosine(F.col("v"), F.lit([float(x) for x in target])), 6).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def imputed(rows: DataFrame, column: str) -> DataFrame:
    """Null entries replaced by the mean."""
    return rows.fillna({column: rows.agg(F.avg(column)).first()[0] or 0.0})
