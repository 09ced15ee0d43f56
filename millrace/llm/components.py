"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links (u, v), u > v. Large: each node's larger neighbours go to its smallest neighbour or itself; small: each node
    and its smaller neighbours go to the smallest of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node that it reaches.

    Each round is written to the shared folder, the rounds before are deleted at the end. A round that changes nothing ends
    it. Every round that changes links moves one at least to a smaller end, so that it ends; it takes about log(n) rounds."""
    with scratch(links.sparkSession) as cut:
        edges = cut(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
        mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        seen, before = mark(edges), None
        while seen[0] and seen != before:
            edges = cut(_star(_star(edges, True), False), "links")
            seen, before = mark(edges), seen
        roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return keep(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
