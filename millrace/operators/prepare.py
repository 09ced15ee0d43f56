"""Preparation of tables: missing values, splits, indices, grids and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def marked_missing(rows: DataFrame, columns: list[str], mark: str = "?") -> DataFrame:
    """The mark of a missing value becomes null, what is left a number; what is no number is null too."""
    return rows.withColumns({c: F.when(F.trim(F.col(c).cast("string")) != mark, F.col(c).cast("string")).try_cast("double") for c in columns})


def null_counts(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """name, nulls: for each column, in one pass."""
    names = columns or rows.columns
    counts = rows.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{k}") for k, c in enumerate(names)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"n{k}").alias("nulls")) for k, c in enumerate(names)])).alias("s")).select("s.*")


def complete(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows of features without a null, with the labels of the same key."""
    return features.na.drop().join(labels, key)


def imputed(rows: DataFrame, means: list[str], modes: list[str]) -> DataFrame:
    """Nulls replaced by a column's mean or by its most frequent value, the least of equally frequent ones. All means are
    one pass; a mode is counted by value, so that only the best meets the driver."""
    fill = dict(zip(means, rows.agg(*[F.avg(c) for c in means]).first(), strict=True)) if means else {}
    for c in modes:
        best = rows.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
        fill[c] = best[c] if best else None
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double") if c in means else F.col(c), F.lit(v)) for c, v in fill.items() if v is not None})


def head_tail(rows: DataFrame, key: str, head: int, tail: int) -> DataFrame:
    """The first `head` and the last `tail` rows by a unique key, with part = head or tail; a row can be in both."""
    return rows.orderBy(key).limit(head).withColumn("part", F.lit("head")).unionByName(rows.orderBy(F.desc(key)).limit(tail).withColumn("part", F.lit("tail")))


def split_of(key: Column, of: int = 5) -> Column:
    """test for one key in `of`, by its own number, else train: the same whatever the engine."""
    return F.when(F.pmod(key, F.lit(of)) == 0, "test").otherwise("train")


def mesh(spark: SparkSession, xs: tuple[float, float, int], ys: tuple[float, float, int]) -> DataFrame:
    """x, y: every point of a grid given by (first, last, how many) on both axes; made from one range, without a join."""
    n = xs[2] * ys[2]
    at = lambda axis, k: F.lit(float(axis[0])) + k * ((axis[1] - axis[0]) / max(axis[2] - 1, 1))
    return spark.range(n).select(at(xs, F.floor(F.col("id") / ys[2])).alias("x"), at(ys, F.col("id") % ys[2]).alias("y"))


def triangular(i: Column, j: Column, m: int) -> Column:
    """Place of the pair i < j < m among all pairs in order; an error for any other pair."""
    place = (i * (2 * m - i - 1) / 2).cast("bigint") + j - i - 1
    return F.when((i >= 0) & (i < j) & (j < m), place).otherwise(F.raise_error(F.lit(f"no pair of 0 <= i < j < {m}")).cast("bigint"))


def dense_index(rows: DataFrame, key: str) -> DataFrame:
    """key, index from 0 over the sorted distinct values. Values are put in order range by range; the driver sees one count
    a range, and no task more than its own."""
    ordered = rows.select(key).distinct().orderBy(key).withColumn("__p", F.spark_partition_id())
    from ..functions.storage import cut

    ordered = cut(ordered.withColumn("__i", F.monotonically_increasing_id()), "index")
    sizes, before, table = {r["__p"]: r["count"] for r in ordered.groupBy("__p").count().collect()}, 0, []
    for p in sorted(sizes):
        table.append((p, before))
        before += sizes[p]
    starts = F.create_map(*[F.lit(x) for pair in table for x in pair]) if table else None
    low = F.expr("__i & 8589934591")  # the place within a partition
    return ordered.select(key, (F.element_at(starts, F.col("__p")) + low).cast("bigint").alias("index")) if table else ordered.select(key, low.alias("index"))


def farthest_from_mean(rows: DataFrame, mean: list[float]) -> DataFrame:
    """id, d2 of the row (id, v) farthest from the mean; the least id of equals."""
    d2 = F.aggregate(F.zip_with("v", F.lit([float(x) for x in mean]), lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x)
    best = rows.select("id", F.round(d2, 9).alias("d2")).agg(F.max_by(F.struct("id", "d2"), F.struct(F.col("d2"), -F.col("id"))).alias("b"))
    return best.select("b.id", "b.d2")


def by_label(rows: DataFrame, key: str, label: str, most: int = 1000) -> DataFrame:
    """label, n, first of the first `most` rows by key: how many there are of each and the least key."""
    return rows.orderBy(key).limit(most).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))


def line_sample(spark: SparkSession, n: int, low: float, high: float, noise: float, seed: int, slope: float = 3.0, offset: float = 7.0) -> DataFrame:
    """id, x, y = slope * x + offset + noise, x even between low and high. Chance is a hash of id and seed, so that reruns
    agree whatever the partitioning."""
    u = lambda k: (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(k)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(2))
    x = F.lit(low) + u(0) * (high - low)
    return spark.range(n).select("id", x.alias("x"), (slope * x + offset + noise * normal).alias("y"))


def sine_sample(spark: SparkSession, n: int, noise: float, seed: int) -> DataFrame:
    """id, x, y: a noisy sine over one period."""
    made = line_sample(spark, n, 0.0, 1.0, noise, seed, 0.0, 0.0)
    return made.select("id", "x", (F.sin(2 * F.pi() * F.col("x")) + F.col("y")).alias("y"))


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (k == label).cast("double"))


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores, shifted by the greatest first."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda t, y: t + y))


def tanh_slope(x: Column) -> Column:
    return 1 - F.tanh(x) * F.tanh(x)


def sigmoid_slope(x: Column) -> Column:
    s = 1 / (1 + F.exp(-x))
    return s * (1 - s)


def accuracy(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"))


def pivoted(rows: DataFrame, index: str, column: str, value: str, values: list) -> DataFrame:
    """One row an index, greatest first, and a column c<value> for each given value of `column`; listing them saves the pass
    that finds them."""
    wide = rows.groupBy(index).pivot(column, values).agg(F.first(value))
    return reduce(lambda df, v: df.withColumnRenamed(str(v), f"c{v}"), values, wide).orderBy(F.desc(index))
