"""Bloom filters as tables of set positions, bit-exact with a SHA-256 based family of hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import seeded_hash


def positions(keys: DataFrame, m: int, k: int, base_seed: int = 0) -> DataFrame:
    """key, at: the k positions of each key."""
    return keys.select("key", F.explode(F.array(*[seeded_hash(F.col("key"), base_seed + i, m) for i in range(k)])).alias("at"))


def build(keys: DataFrame, m: int, k: int, base_seed: int = 0) -> DataFrame:
    """at: the distinct set positions."""
    return positions(keys, m, k, base_seed).select("at").distinct()


def probe(keys: DataFrame, bits: DataFrame, m: int, k: int, base_seed: int = 0) -> DataFrame:
    """key, hit: whether all its positions are set. Keys are distinct."""
    found = positions(keys, m, k, base_seed).join(bits.withColumn("__set", F.lit(1)), "at", "left")
    return found.groupBy("key").agg((F.sum(F.coalesce("__set", F.lit(0))) == F.count(F.lit(1))).alias("hit"))


def false_positive_rate(probes: DataFrame) -> DataFrame:
    return probes.agg(F.coalesce(F.avg(F.col("hit").cast("int")), F.lit(0.0)).alias("fpr"))


def cascade(keys: DataFrame, inserted: DataFrame, m1: int, m2: int, k1: int, k2: int) -> DataFrame:
    """key, hit: both stages, with base seeds 0 and 1000, must agree."""
    a = probe(keys, build(inserted, m1, k1), m1, k1)
    b = probe(keys, build(inserted, m2, k2, 1000), m2, k2, 1000).withColumnRenamed("hit", "hit2")
    return a.join(b, "key").select("key", (F.col("hit") & F.col("hit2")).alias("hit"))


def sweep(inserted: DataFrame, probed: DataFrame, m: int, ks: list[int], base_seed: int = 0) -> DataFrame:
    """k, fpr for filters of the first k hashes, k ascending. Keys are hashed once, up to the greatest k: a position is known
    by the number of the first hash that sets it, so that a filter of k hashes has those set by hash k or one before, and a
    probe of k hashes passes if each of its first k positions does."""
    most = max(ks)
    first = _numbered(inserted, m, most, base_seed).groupBy("at").agg(F.min("h").alias("set_by"))
    found = _numbered(probed, m, most, base_seed).join(first, "at", "left").groupBy("key").agg(*[F.max(F.when(F.col("h") < k, F.coalesce("set_by", F.lit(most)))).alias(f"w{k}") for k in ks])
    rates = found.agg(*[F.coalesce(F.avg((F.col(f"w{k}") < k).cast("int")), F.lit(0.0)).alias(f"w{k}") for k in ks])
    return rates.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"w{k}").alias("fpr")) for k in ks])).alias("s")).select("s.*")


def _numbered(keys: DataFrame, m: int, k: int, base_seed: int) -> DataFrame:
    return keys.select("key", F.posexplode(F.array(*[seeded_hash(F.col("key"), base_seed + i, m) for i in range(k)])).alias("h", "at"))


def cascade_and_dense(inserted: DataFrame, probed: DataFrame, m1: int, m2: int, k1: int, k2: int, k_dense: int) -> DataFrame:
    """fpr_cascade, fpr_dense: two stages against one filter of as many bits together."""
    two = false_positive_rate(cascade(probed, inserted, m1, m2, k1, k2)).withColumnRenamed("fpr", "fpr_cascade")
    one = false_positive_rate(probe(probed, build(inserted, m1 + m2, k_dense), m1 + m2, k_dense)).withColumnRenamed("fpr", "fpr_dense")
    return two.join(one, F.lit(True))  # one row by one
