"""Singular values, reconstructions and principal components of tall matrices (id, v).

A Gram matrix of a few hundred columns is summed where the rows lie; its eigenpairs are the driver's work, and whatever has
a row for each row of the matrix (left vectors, reconstructions, scores) is an expression over the rows with literals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import dot
from .learners import principal, projected
from .stats import covariance

#: Singular values up to this count as nothing.
LEAST = 1e-9


def literal_matrix(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    """id, v: a small matrix given in place."""
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, v array<double>")


def gram_sums(rows: DataFrame, vector: str, width: int) -> DataFrame:
    """i, j, v: entries of the transpose times the matrix. Each task sends one sum of outer products."""

    def sums(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    table = rows.select(F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") == width)
    return table.mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def gram_array(rows: DataFrame, vector: str, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    for r in gram_sums(rows, vector, width).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def row_products(rows: DataFrame) -> DataFrame:
    """i, j, v: entries of the matrix times its transpose, for matrices of few rows; the result has a row for each pair."""
    a, b = rows.select(F.col("id").alias("i"), F.col("v").alias("a")), rows.select(F.col("id").alias("j"), F.col("v").alias("b"))
    return a.join(b, F.lit(True)).select("i", "j", dot(F.col("a"), F.col("b")).alias("v"))


def singular(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors as columns), greatest first; each vector's largest entry is positive."""
    values, vectors = principal(gram, len(gram))
    return np.sqrt(np.maximum(values, 0)), vectors


def left_vectors(rows: DataFrame, sigma: np.ndarray, v: np.ndarray) -> DataFrame:
    """id, v, w: each row's entries in the left vectors; 0 where a singular value counts as nothing."""
    return projected(rows, v * np.where(sigma > LEAST, 1 / np.where(sigma > LEAST, sigma, 1), 0.0))


def reconstructed(rows: DataFrame, v: np.ndarray, k: int) -> DataFrame:
    """id, v: the best approximation of rank k."""
    inner = projected(rows, v[:, :k]).select("id", F.col("w").alias("v"))
    return projected(inner, v[:, :k].T).select("id", F.col("w").alias("v"))


def energy(sigma: np.ndarray) -> list[float]:
    """For each k the share of the squared singular values that the k greatest have; 0 for a matrix of zeros."""
    squares = np.asarray(sigma, float) ** 2
    return (np.cumsum(squares) / squares.sum()).tolist() if squares.sum() > 0 else [0.0] * len(squares)


def components_for(variances: np.ndarray, share: float = 0.95) -> int:
    """The least number of components, greatest first, that together explain the share of the variance."""
    part = np.cumsum(variances) / max(float(np.sum(variances)), 1e-300)
    return int(np.argmax(part >= share - 1e-12)) + 1 if len(part) and part[-1] > 0 else 0


def column_moments(rows: DataFrame, vector: str) -> tuple[list[float], list[float]]:
    """Mean and population deviation of each column."""
    long = rows.select(F.posexplode(F.col(vector).cast("array<double>")).alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    got = long.orderBy("d").collect()
    return [r["m"] for r in got], [r["s"] for r in got]


def principal_scores(rows: DataFrame, width: int, k: int | None = None, share: float | None = None, standardised: bool = False) -> tuple[DataFrame, np.ndarray]:
    """(id, w of the centred rows in the leading directions; all variances). k or the share of variance says how many;
    standardised divides each column by its deviation first, a constant one by 1."""
    mean, deviation = column_moments(rows, "v")
    scale = np.array([s if standardised and s > 0 else 1.0 for s in deviation])
    cov = covariance(rows, "v", width) / np.outer(scale, scale)
    variances, directions = principal(cov, width)
    n = k if k is not None else components_for(variances, share or 1.0)
    return projected(rows, directions[:, :n] / scale[:, None], mean).select("id", "w"), variances
