"""Graph operators over edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import cut, drop_cut


def clean(edges: DataFrame) -> DataFrame:
    """Distinct edges without self-loops."""
    return edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def mutual_edges(edges: DataFrame) -> DataFrame:
    """u < v for which both directions exist."""
    pair = clean(edges).groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    return pair.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 2).select("u", "v")


def chordless_squares(mutual: DataFrame) -> DataFrame:
    """u, v, w, x ascending: vertex sets that induce a cycle of four. With u the least vertex of the square and w the one
    across, every square comes once, so that nothing needs to be made distinct."""
    both = mutual.select("u", "v").unionByName(mutual.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = mutual.select("u", F.col("v").alias("mid"))  # u < mid
    wedge = low.join(both.select(F.col("u").alias("mid"), F.col("v").alias("w")), "mid").filter(F.col("u") < F.col("w"))
    open_ = wedge.join(mutual.select("u", F.col("v").alias("w")), ["u", "w"], "left_anti")
    a, b = open_.select("u", "w", F.col("mid").alias("v")), open_.select("u", "w", F.col("mid").alias("x"))
    squares = a.join(b, ["u", "w"]).filter(F.col("v") < F.col("x")).join(mutual.select(F.col("u").alias("v"), F.col("v").alias("x")), ["v", "x"], "left_anti")
    s = F.array_sort(F.array("u", "v", "w", "x"))
    return squares.select(*[F.get(s, F.lit(k)).alias(n) for k, n in enumerate("uvwx")])


def head_and_tail(rows: DataFrame, keys: list[str], most: int = 20, each: int = 10) -> DataFrame:
    """All rows if there are at most `most`, else the first and the last `each` by keys."""
    if rows.limit(most + 1).count() <= most:
        return rows.orderBy(*keys)
    return rows.orderBy(*keys).limit(each).unionByName(rows.orderBy(*[F.desc(k) for k in keys]).limit(each))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def dead_ends(edges: DataFrame) -> DataFrame:
    """Nodes that no edge leaves."""
    return nodes(edges).join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def spider_traps(edges: DataFrame) -> DataFrame:
    """Nodes whose only edge is a self-loop, and both of a pair whose only other neighbour is each other."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("src") != F.col("dst")).cast("int")).alias("others"), F.max(F.when(F.col("src") != F.col("dst"), F.col("dst"))).alias("other"))
    alone = out.filter((F.col("n") == 1) & (F.col("others") == 0)).select(F.col("src").alias("node"))
    one = out.filter(F.col("others") == 1).select(F.least("src", "other").alias("u"), F.greatest("src", "other").alias("v"))
    pairs = one.groupBy("u", "v").count().filter(F.col("count") == 2).select(F.explode(F.array("u", "v")).alias("node"))
    return alone.unionByName(pairs).distinct()


def page_rank(edges: DataFrame, beta: float = 0.9, rounds: int = 50, tolerance: float = 1e-5) -> DataFrame:
    """node, rank. Starts even; dead ends spread their rank evenly; ends once the change's L2 norm is below tolerance.

    Ranks stay distributed. A round is one write: of a node's old rank and of what it was given. What is spread evenly only
    needs the sum of what was given, and goes into the expression of the new rank, so that the change, too, comes from sums of
    the same one pass. The round before is deleted."""
    e = cut(edges.select("src", "dst").distinct().join(edges.groupBy("src").agg(F.countDistinct("dst").alias("deg")), "src"), "edges")
    state = cut(nodes(edges).select("node", F.lit(0.0).alias("old"), F.lit(0.0).alias("got")), "ranks")
    n = state.count()
    if not n:
        return state.select("node", F.lit(0.0).alias("rank"))
    rank, done = F.lit(1.0 / n), state
    for _ in range(rounds):
        ranks = state.select("node", rank.alias("rank"))
        given = e.join(ranks, e["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        state = cut(ranks.withColumnRenamed("rank", "old").join(given.withColumnRenamed("dst", "node"), "node", "left").select("node", "old", F.coalesce("got", F.lit(0.0)).alias("got")), "ranks")
        drop_cut(done)
        done = state
        # new = even + beta * got; the change's norm from sums of d = beta * got - old
        d = beta * F.col("got") - F.col("old")
        passed, dd, d1 = state.agg(F.sum("got"), F.sum(d * d), F.sum(d)).first()
        even = (1 - beta) / n + beta * (1 - passed) / n
        rank = F.lit(even) + beta * F.col("got")
        if max(0.0, dd + 2 * even * d1 + n * even * even) ** 0.5 < tolerance:
            break
    return state.select("node", rank.alias("rank"))


def neighbours(mutual: DataFrame) -> DataFrame:
    """node, nbrs (ascending) of an undirected graph."""
    both = mutual.select(F.col("u").alias("node"), F.col("v").alias("nbr")).unionByName(mutual.select(F.col("v").alias("node"), F.col("u").alias("nbr")))
    return both.groupBy("node").agg(F.array_sort(F.collect_set("nbr")).alias("nbrs"))


def biased_walks(mutual: DataFrame, p: float, q: float, length: int = 5) -> DataFrame:
    """start, step, node: from each node to its least neighbour, then always to the neighbour of greatest weight: 1/p back,
    1 to a neighbour of the node before, 1/q elsewhere; ties to the least id. Every step is one equi-join with the edges
    and one left join that tells neighbours of the node before."""
    both = mutual.select("u", "v").unionByName(mutual.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    at = both.groupBy(F.col("u").alias("start")).agg(F.min("v").alias("cur")).select("start", F.col("start").alias("prev"), "cur", F.array("start", "cur").alias("walk"))
    for _ in range(length - 2):
        near = both.select(F.col("u").alias("prev"), F.col("v").alias("nbr"), F.lit(True).alias("tied"))
        options = at.join(both.select(F.col("u").alias("cur"), F.col("v").alias("nbr")), "cur").join(near, ["prev", "nbr"], "left")
        weight = F.when(F.col("nbr") == F.col("prev"), F.lit(1.0 / p)).when(F.col("tied"), F.lit(1.0)).otherwise(F.lit(1.0 / q))
        best = options.groupBy("start").agg(F.max_by(F.struct("cur", "nbr", "walk"), F.struct(weight, -F.col("nbr"))).alias("b"))
        at = best.select("start", F.col("b.cur").alias("prev"), F.col("b.nbr").alias("cur"), F.concat("b.walk", F.array("b.nbr")).alias("walk"))
    return at.select("start", F.posexplode("walk").alias("step", "node"))


def random_walks(mutual: DataFrame, length: int = 5, seed: int = 1) -> DataFrame:
    """start, step, node: uniform walks whose choices are hashes of start, step and seed."""
    nbrs = neighbours(mutual)
    at = nbrs.select(F.col("node").alias("start"), F.col("node").alias("cur"), F.array("node").alias("walk"))
    for step in range(length - 1):
        chosen = F.get("nbrs", F.pmod(F.xxhash64("start", F.lit(step), F.lit(seed)), F.size("nbrs")).cast("int"))
        at = at.join(nbrs, F.col("cur") == F.col("node")).select("start", chosen.alias("cur"), F.concat("walk", F.array(chosen)).alias("walk"))
    return at.select("start", F.posexplode("walk").alias("step", "node"))


def window_pairs(walks: DataFrame, reach: int = 2) -> DataFrame:
    """center, context, n: how often two positions of a walk are at most `reach` apart, each order counted."""
    a, b = walks.select("start", F.col("step").alias("i"), F.col("node").alias("center")), walks.select("start", F.col("step").alias("j"), F.col("node").alias("context"))
    near = (F.col("i") != F.col("j")) & (F.abs(F.col("i") - F.col("j")) <= reach)
    return a.join(b, "start").filter(near).groupBy("center", "context").agg(F.count(F.lit(1)).alias("n"))


def neighbour_mean(edges: DataFrame, features: DataFrame) -> DataFrame:
    """node, d, value: the mean of the neighbours' features; features come long as (node, d, value)."""
    f = features.select(F.col("node").alias("dst"), "d", "value")
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    return edges.join(f, "dst").groupBy("src", "d").agg(F.sum("value").alias("s")).join(degree, "src").select(F.col("src").alias("node"), "d", (F.col("s") / F.col("deg")).alias("value"))


def sage_layer(edges: DataFrame, features: DataFrame, weights: Column, width: int, out: int, relu: bool) -> DataFrame:
    """One mean-aggregating layer: [own, neighbours' mean] times weights[in][out], by joins and sums in long form.
    `weights` is an array column of 2 * width arrays of `out` numbers, the same for all rows."""
    own = features.select("node", "d", "value")
    mean = neighbour_mean(edges, features).select("node", (F.col("d") + width).alias("d"), "value")
    row = F.get(weights, F.col("d"))
    parts = own.unionByName(mean).select("node", *[(F.col("value") * F.get(row, F.lit(k))).alias(f"o{k}") for k in range(out)])
    sums = parts.groupBy("node").agg(*[F.sum(f"o{k}").alias(f"o{k}") for k in range(out)])
    value = [F.greatest(F.lit(0.0), F.col(f"o{k}")) if relu else F.col(f"o{k}") for k in range(out)]
    return sums.select("node", F.posexplode(F.array(*value)).alias("d", "value"))


def rank_order(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k greatest by score, ties to the least key."""
    return rows.orderBy(F.desc(score), key).limit(k)


def top_per_group(rows: DataFrame, group: str, score: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(score), F.desc(key))
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")
