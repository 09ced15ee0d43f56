"""Column expressions that operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalized(text: Column) -> Column:
    """Lower case, only a-z and the space kept."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z ]+", "")


def tokens(text: Column) -> Column:
    """Non-empty words of a normalised text."""
    return F.filter(F.split(text, " +"), lambda w: w != "")


def shingles(text: Column, k: int) -> Column:
    """The distinct runs of k characters; none for shorter texts. Characters are split once, so it takes linear time."""

    def runs(c: Column) -> Column:
        return F.when(F.size(c) < k, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - k), lambda i: F.concat(*[F.get(c, i + j) for j in range(k)]))))

    return bind(F.filter(F.split(text, ""), lambda x: x != ""), runs)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a vector is 0."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def floor5(x: Column) -> Column:
    """Rounded down to five decimals."""
    return F.floor(x * 100000) / 100000


def seeded_hash(key: Column, seed: int, modulus: int) -> Column:
    """SHA-256 of a 4-byte little-endian seed and the key's bytes; its first 8 bytes, little-endian unsigned, modulo."""
    digest = F.sha2(F.concat(F.lit(seed.to_bytes(4, "little")), key.cast("binary")), 256)
    little = F.concat(*[F.substring(digest, 2 * k + 1, 2) for k in range(7, -1, -1)])
    return (F.conv(little, 16, 10).cast("decimal(20,0)") % modulus).cast("bigint")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x))))
