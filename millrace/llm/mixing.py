"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source whose target is m times its size is copied floor(m) or floor(m)+1 times. The fractions are rounded
by the pivotal method: two documents meet and words move at random from one's fraction to the other's, with odds that keep
each one's expectation, until one of the fractions is whole; the other goes on to meet the next. As words move, and not
documents, a meeting doesn't change what its source gives. Inside a leaf (a few hundred documents of one source, largest
first) that is a fold over a sorted array; what stays fractional, one document a leaf, meets its neighbours' in the next
level of a tree of fan-out 64, and so on to one root a source. The last fraction is rounded by itself. The words that this
leaves over or short are settled from the largest to the smallest of a few documents, the two smallest candidates of each
half octave of size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, let, materialize, scratch

# Fixed values of the mix: weights by the order of the sources, and how often a document may be taken at most.
WEIGHTS = (5, 2, 1)
MOST = 3
LEAF, FAN_OUT = 256, 64
_UNIT = "struct<size:bigint,doc_id:bigint,occ:int,p:double,copies:int,source:string,source_size:bigint,target:double>"
_NEAR = 1e-9


def targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, source_at, target: the share of all words by weight, at most `most` times the source's size.

    What is over goes to the others by weight until none is over; in one pass, as sources in the order of cap/weight reach
    their caps one after the other. The windows run over one row a source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weighed = sources.withColumn("source_at", at).withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_at") % len(weights))).withColumn("cap", F.col("source_size") * float(most))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "source_at").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    run = weighed.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("all_w", F.sum("weight").over(every)).withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    capped = F.col("cap") * (F.col("all_w") - F.col("w_before")) <= (F.col("total") - F.col("cap_before")) * F.col("weight")
    run = run.withColumn("capped", capped)
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    open_w = F.sum(F.when(F.col("capped"), F.lit(0.0)).otherwise(F.col("weight"))).over(every)
    return run.select("source", "source_size", "source_at", F.when(F.col("capped"), F.col("cap")).otherwise(left * F.col("weight") / open_w).alias("target"))


def _uniform(a: Column, b: Column, seed: int) -> Column:
    h = F.xxhash64(F.lit(seed), a["doc_id"], a["occ"], b["doc_id"], b["occ"])
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def _meet(a: Column, b: Column, seed: int) -> Column:
    """struct(done, on): the unit whose fraction became whole, and the one that goes on with the words that moved. Both have
    words. Words in fractions, p times size, are the same before and after."""

    def go(t: Column) -> Column:
        gains = _uniform(a, b, seed) * (t["up"] + t["down"]) < t["down"]
        ends = F.when(gains, t["room_a"] <= t["mass_b"]).otherwise(t["mass_a"] <= t["room_b"])  # whether a is the one that ends
        whole = (gains == ends).cast("double")
        left = t["mass_a"] + t["mass_b"] - whole * F.when(ends, a["size"]).otherwise(b["size"])
        fit = lambda u: F.greatest(F.lit(0.0), F.least(F.lit(1.0), left / u["size"]))
        return F.when(ends, F.struct(a.withField("p", whole).alias("done"), b.withField("p", fit(b)).alias("on"))).otherwise(
            F.struct(b.withField("p", whole).alias("done"), a.withField("p", fit(a)).alias("on"))
        )

    mass = lambda u: u["p"] * u["size"]
    room = lambda u: (1 - u["p"]) * u["size"]
    state = F.struct(mass(a).alias("mass_a"), mass(b).alias("mass_b"), room(a).alias("room_a"), room(b).alias("room_b"), F.least(room(a), mass(b)).alias("up"), F.least(mass(a), room(b)).alias("down"))
    return let(state, go)


def pivoted(units: Column, seed: int) -> Column:
    """The same units with all but at most one of them rounded, by the pivotal method in the array's order."""
    begin = F.struct(F.get(units, F.lit(0)).alias("on"), F.array().cast(f"array<{_UNIT}>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        return let(_meet(acc["on"], x, seed), lambda t: F.struct(t["on"].alias("on"), F.concat(acc["done"], F.array(t["done"])).alias("done")))

    return F.aggregate(F.slice(units, 2, F.size(units)), begin, step, lambda acc: F.concat(acc["done"], F.array(acc["on"])))


def _rounded(units: DataFrame, seed: int, nodes: int, fan_out: int, cut) -> DataFrame:
    """(source_at, unit) with every fraction p at 0 or 1, by the tree of meetings from the leaves' `node` numbers."""
    alone = (F.col("unit.p") <= _NEAR) | (F.col("unit.size") == 0)
    done, open_, level = [_by_chance(units.filter(alone), seed)], units.filter(~alone), 0
    while True:
        folded = open_.groupBy("source_at", "node").agg(F.sort_array(F.collect_list("unit"), False).alias("units"))
        made = cut(folded.select("source_at", "node", F.explode(pivoted(F.col("units"), seed + 1 + level)).alias("unit")), f"level{level}")
        whole = (F.col("unit.p") <= _NEAR) | (F.col("unit.p") >= 1 - _NEAR)
        done.append(made.filter(whole))
        open_ = made.filter(~whole).withColumn("node", F.floor(F.col("node") / fan_out))
        if nodes <= 1:
            break
        nodes, level = -(-nodes // fan_out), level + 1
    return reduce(DataFrame.unionByName, [*done, _by_chance(open_, seed)]).select("source_at", F.col("unit").withField("copies", F.col("unit.copies") + F.round("unit.p").cast("int")).alias("unit"))


def _by_chance(units: DataFrame, seed: int) -> DataFrame:
    """Each fraction rounded by itself."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("unit.doc_id"), F.col("unit.occ")), 11).cast("double") * F.lit(2.0**-53)
    return units.withColumn("unit", F.col("unit").withField("p", F.when(F.col("unit.p") <= _NEAR, 0.0).otherwise((u < F.col("unit.p")).cast("double"))))


def _settled(rounded: DataFrame, most: int) -> DataFrame:
    """(source_at, doc_id, occ, size, delta): copies to add or take away so that a source comes within half its smallest
    document of its target, unless that document is used up.

    A source's candidates are, for each half octave of size, its smallest document that can be taken once more and its
    smallest that can be taken once less: a bounded list. From the largest on, each moves the source as near to its target as
    it can, or else no further than what smaller ones can fill up; the better of the two ways holds."""
    unit = F.col("unit")
    octave = F.floor(F.log2(unit["size"].cast("double")) * 2)
    key = F.struct(unit["size"].alias("size"), F.xxhash64(unit["doc_id"], unit["occ"]).alias("by"), unit["doc_id"].alias("doc_id"), unit["occ"].alias("occ"), unit["copies"].alias("copies"))
    groups = rounded.filter(unit["size"] > 0).groupBy("source_at", octave.alias("octave")).agg(
        F.sum(unit["size"] * unit["copies"]).alias("taken"), F.first(unit["target"]).alias("target"), F.min(F.when(unit["copies"] < most, key)).alias("more"), F.min(F.when(unit["copies"] > 0, key)).alias("less"),
    )
    kind = "array<struct<size:bigint,by:bigint,doc_id:bigint,occ:int,copies:int,add:boolean>>"
    tagged = lambda c, add: F.when(F.col(c).isNotNull(), F.array(F.col(c).withField("add", F.lit(add)))).otherwise(F.array().cast(kind))
    each = groups.groupBy("source_at").agg((F.first("target") - F.sum("taken")).alias("short"), F.sort_array(F.flatten(F.collect_list(F.concat(tagged("more", True), tagged("less", False)))), False).alias("list"))

    def walk(wanted) -> Column:
        def step(acc: Column, c: Column) -> Column:
            n = wanted(acc["short"] / c["size"]).cast("int")
            n = F.when(c["add"], F.greatest(F.lit(0), F.least(F.lit(most) - c["copies"], n))).otherwise(F.least(F.lit(0), F.greatest(-c["copies"], n)))
            return let(n, lambda n: F.struct((acc["short"] - n * c["size"]).alias("short"), F.when(n != 0, F.concat(acc["o"], F.array(F.struct(c["doc_id"].alias("doc_id"), c["occ"].alias("occ"), c["size"].alias("size"), n.alias("delta"))))).otherwise(acc["o"]).alias("o")))

        return F.aggregate("list", F.struct(F.col("short").alias("short"), F.array().cast("array<struct<doc_id:bigint,occ:int,size:bigint,delta:int>>").alias("o")), step)

    both = each.select("source_at", walk(F.round).alias("x"), walk(F.floor).alias("y"))
    better = F.when(F.abs("y.short") < F.abs("x.short"), F.col("y.o")).otherwise(F.col("x.o"))
    moves = both.select("source_at", F.explode(better).alias("m"))
    return moves.groupBy("source_at", "m.doc_id", "m.occ", "m.size").agg(F.sum("m.delta").cast("int").alias("delta"))


def mix(documents: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 20, leaf: int = LEAF, fan_out: int = FAN_OUT) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source: one row per row of documents.

    size is the number of words of the whole text (null: 0). A null source is a source of its own, after the others.
    Reruns agree whatever the partitioning: all chance comes from hashes of ids, and rows of the same id, source and size
    are numbered; equal hashes decide nothing, as units are ordered by size, id and number. Null ids are one id. Empty tables
    give no rows; a source without words has target 0 and is taken 0 times. Other columns are ignored, whatever their names."""
    with scratch(documents.sparkSession) as cut:
        sized = cut(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")), "sizes")
        ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        plan = targets(sized, weights, most).withColumn("ratio", ratio).withColumn("copies", F.floor(F.col("ratio") + _NEAR).cast("int")).withColumn("p", F.greatest(F.lit(0.0), F.col("ratio") - F.col("copies")))
        counts = sized.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / leaf).alias("leaves")).withColumnRenamed("source", "c")
        plan = cut(plan.join(counts, F.col("source").eqNullSafe(F.col("c"))).select(F.col("source").alias("s"), "source_at", "source_size", "target", "copies", "p", "leaves"), "targets")
        most_leaves = plan.agg(F.max("leaves")).first()[0] or 1
        occ = F.row_number().over(Window.partitionBy("source", "doc_id", "size").orderBy(F.lit(1)))
        units = sized.withColumn("occ", occ).join(plan, F.col("source").eqNullSafe(F.col("s")))
        unit = F.struct("size", "doc_id", "occ", "p", "copies", "source", "source_size", "target").cast(_UNIT).alias("unit")
        units = units.select("source_at", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "occ"), F.col("leaves")).alias("node"), unit)
        rounded = cut(_rounded(units, seed, most_leaves, fan_out, cut), "rounded")
        moves = cut(_settled(rounded, most), "moves").select(F.col("source_at").alias("at"), F.col("doc_id").alias("id"), F.col("occ").alias("o"), F.col("size").alias("z"), "delta")
        same = (F.col("source_at") == F.col("at")) & F.col("unit.doc_id").eqNullSafe(F.col("id")) & (F.col("unit.occ") == F.col("o")) & (F.col("unit.size") == F.col("z"))
        copies = F.col("unit.copies") + F.coalesce("delta", F.lit(0))
        return materialize(rounded.join(moves, same, "left").select("unit.doc_id", "unit.size", "unit.source_size", "unit.target", (F.col("unit.size") * copies).alias("taken"), copies.alias("copies"), "unit.source"), "mixed")


def take(documents: DataFrame, **options) -> DataFrame:
    """documents, each row as often as the mix takes it; rows of the same id, source and size share their copies evenly
    in no certain order, as nothing tells them apart but their text."""
    keep = documents.columns
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    occ = F.row_number().over(Window.partitionBy("__m_source", "__m_id", "__m_size").orderBy("__m_size"))
    mixed = mix(documents, **options).filter(F.col("copies") > 0).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("__m_id"), F.col("source").alias("__m_source"), F.col("size").alias("__m_size"), F.col("copies").alias("__m_copies"))
    repeats = mixed.groupBy("__m_id", "__m_source", "__m_size").agg(F.sort_array(F.collect_list("__m_copies"), False).alias("__m_all"))
    rows = documents.select("*", F.coalesce("doc_id", F.lit(-(2**63))).alias("__id"), F.col("source").cast("string").alias("__source"), size.alias("__size"))
    joined = rows.join(repeats, (F.col("__id") == F.col("__m_id")) & F.col("__source").eqNullSafe(F.col("__m_source")) & (F.col("__size") == F.col("__m_size")))
    unique = joined.filter(F.size("__m_all") == 1).withColumn("__n", F.get("__m_all", F.lit(0)))
    several = joined.filter(F.size("__m_all") > 1).withColumn("__n", F.coalesce(F.get("__m_all", F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy("text")) - 1), F.lit(0)))
    return unique.unionByName(several).filter(F.col("__n") > 0).select(*[F.col(f"`{c}`") for c in keep], F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*[F.col(f"`{c}`") for c in keep])
