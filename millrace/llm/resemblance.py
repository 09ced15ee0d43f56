"""Near-duplicates by the true Jaccard likeness of word shingles, whole.

Fingerprints come first: texts whose SimHashes share a Golay key and lie within 2 bits are compared, and what is alike is
linked. That can't be all, as texts of likeness 0.8 mostly differ in 3 to 11 of 64 bits, where Golay keys tell little apart.
The rest is found by prefix filtering. Whatever the order of all shingles, two sets of likeness 0.8 or more share one of the
first n - ceil(0.8 n) + 1 of each: a key of one such shingle finds every pair. Common shingles come last in the order, which
keeps groups of a key small. The parities of shingles in 256 bits differ in at most as many bits as the sets in members, so
that they rule out pairs without a miss. Wider parities then rule out more, and settle what is so alike that sets too
far apart would show it with a chance of under 1e-9; the rest is compared shingle by shingle. Shingles and sets are known by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import release
from . import golay
from .common import materialize, scratch, tidy
from .components import components
from .golay import majority

WIDTH = 5
#: The least likeness of a link is 4/5; all tests of it are in whole numbers.
SEED = 42
#: Groups of a key over this size are first tied through a few of their members; pairs that this leaves apart are compared.
BUCKET, HUBS, HUB_ROUNDS = 16, 3, 2
#: Shingles held to be common: in at least COMMON of the documents of a sample, at most MOST_COMMON. They only affect speed.
SAMPLE, COMMON, MOST_COMMON = 16, 4, 200_000
_MAPS = ["m0", "m1", "m2", "m3"]
#: Candidate pairs are held against wider parities before their sets are: of 4 bits a shingle or more, a power of two up to
#: MOST_WIDE. They settle a pair if they differ by so many standard deviations, and then so many bits, less than the least
#: difference that is too much would show.
LEAST_WIDE, MOST_WIDE, DEVIATIONS, SPARE = 256, 1 << 17, 8.0, 8.0
#: Python hands over rows in batches of about so many numbers, as one set may be long.
BATCH = 250_000
#: log2 of the bits of the map by which rows are chosen before they are shuffled; it has at most 2^(MAP_BITS - 6) words.
MAP_BITS = 26


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of a text's distinct shingles, ascending. A-Z are lower-cased; fewer words than `width` make one shingle."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return np.empty(0, np.int64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, SEED) for w in ws), np.uint64, len(ws))
    width = min(width, len(ws))
    made = np.zeros(len(ws) - width + 1, np.uint64)
    for k in range(width):
        made = made * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        made = (made ^ (made >> np.uint64(shift))) * np.uint64(factor)
    return np.unique((made ^ (made >> np.uint64(31))).view(np.int64))


def keys(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which two sets of likeness 4/5 share one: the first in the order of (common, hash)."""
    n = len(found)
    if not n:
        return found
    last = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found if len(common) else np.zeros(n, bool)
    return np.concatenate((found[~last], found[last]))[: n - (4 * n + 4) // 5 + 1]


def parities(found: np.ndarray, bits: int = 256) -> np.ndarray:
    """Words of 64 bits: bit b is the parity of the shingles whose hash ends in b."""
    return np.packbits(np.bincount(found & (bits - 1), minlength=bits) & 1, bitorder="little").view(np.int64)


def wide(found: np.ndarray) -> np.ndarray:
    """Parities in a power of two of bits that is 4 or more a shingle."""
    return parities(found, min(MOST_WIDE, max(LEAST_WIDE, 1 << (4 * len(found) - 1).bit_length())) if len(found) else LEAST_WIDE)


def _batches(rows: Iterator[tuple[list, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, each of which comes with the numbers in it."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _texts(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _sets(texts: DataFrame) -> DataFrame:
    """(h, found): each text's shingles."""
    longs = pa.list_(pa.int64())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, int]]:
        for batch in batches:
            for h, text in zip(batch.column(0), batch.column(1), strict=True):
                found = shingles(text.as_py())
                yield (h.as_py(), found), len(found) + 1

    return texts.select("h", "text").mapInArrow(lambda b: tidy(_batches(rows(b), pa.schema([("h", pa.int64()), ("found", longs)]))), "h bigint, found array<bigint>")


def _common(texts: DataFrame) -> np.ndarray:
    part = _sets(texts.filter(F.pmod(F.col("h"), F.lit(SAMPLE)) == 0)).select(F.explode("found").alias("s"))
    often = part.groupBy("s").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(MOST_COMMON)
    return np.sort(often.select("s").toArrow().column("s").to_numpy())


def _described(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """(doc_id, h, node, n, print, keys, wide, m0..m3) of each row; node is the hash of its set of shingles, print their SimHash."""
    long, longs = pa.int64(), pa.list_(pa.int64())
    schema = pa.schema([("doc_id", long), ("h", long), ("node", long), ("n", pa.int32()), ("print", long), ("keys", longs), ("wide", longs), *((m, long) for m in _MAPS)])
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, int]]:
        for batch in batches:
            for doc_id, h, text in zip(*batch.columns, strict=True):
                found = shingles(text.as_py())
                first, parity = keys(found, common), wide(found)
                node = signed(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                yield (doc_id.as_py(), h.as_py(), node, len(found), signed(majority(found.view(np.uint64))), first, parity, *parities(found).tolist()), len(first) + len(parity) + 9

    return texts.mapInArrow(lambda b: tidy(_batches(rows(b), schema)), "doc_id bigint, h bigint, node bigint, n int, print bigint, keys array<bigint>, wide array<bigint>, " + ", ".join(f"{m} bigint" for m in _MAPS))


def _near() -> Column:
    """Whether the rows a and b of a join by key can be of likeness 4/5 and are not linked yet."""
    n = F.col("a.n") + F.col("b.n")
    apart = sum((F.bit_count(F.col(f"a.{m}").bitwiseXOR(F.col(f"b.{m}"))) for m in _MAPS), F.lit(0))
    return (F.col("a.component") != F.col("b.component")) & (5 * F.col("a.n") >= 4 * F.col("b.n")) & (5 * F.col("b.n") >= 4 * F.col("a.n")) & (9 * apart <= n)


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    ends = [F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")]
    return left.alias("a").join(right.alias("b"), (F.col("a.key") == F.col("b.key")) & _near()).select(*ends).distinct()


def _all_pairs(live: DataFrame) -> DataFrame:
    ends = [F.col("a.node").alias("a"), F.col("b.node").alias("b")]
    return live.alias("a").join(live.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & _near()).select(*ends).distinct()


def _hub_pairs(live: DataFrame, turn: int) -> DataFrame:
    """Pairs of each member with a few of its key's."""
    row = ["node", "n", "component", *_MAPS]
    picked = live.groupBy("key").agg(F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(turn * HUBS + k)).alias("by"), *row)) for k in range(HUBS)]).alias("hubs"))
    hubs = picked.select("key", F.explode("hubs").alias("hub")).select("key", *[F.col(f"hub.{c}").alias(c) for c in row])
    return _pairs(hubs, live)


def _among(rows: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """rows whose hash in column `name` may be among asked's: all that are, and a few others. A map of bits tells, so that
    what nobody asks for isn't shuffled; its size has a fixed bound, beyond some millions of hashes it just tells less."""
    slot = f"({name} & {(1 << MAP_BITS) - 1}L)"
    bit = f"shiftleft(1L, cast({slot} & 63 as int))"
    words = asked.select(F.expr(f"shiftright({slot}, 6)").alias("__word"), F.expr(bit).alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    found = rows.withColumn("__at", F.expr(f"shiftright({slot}, 6)")).join(F.broadcast(words), F.col("__at") == F.col("__word"))
    return found.filter(F.expr(f"(__bits & {bit}) != 0")).drop("__at", "__word", "__bits")


def _sure(apart: Column, n: Column, bits: Column) -> Column:
    """Whether sets of n members together, whose parities in so many bits are `apart` apart, can be held to be of likeness 4/5.
    The least difference that is too much is n/9 and some; the number of odd places that so many shingles leave has a known
    mean and variance."""
    m = bits.cast("double")
    least = (F.floor(n / 9) + 1).cast("double")
    one, two = F.pow(1 - 2 / m, least), F.pow(1 - 4 / m, least)
    odd = (1 - one) / 2
    variance = m * odd + m * (m - 1) * (1 - 2 * one + two) / 4 - m * m * odd * odd
    return apart <= m * odd - DEVIATIONS * F.sqrt(F.greatest(variance, F.lit(0.0))) - SPARE


def _folded(v: Column, size: Column) -> Column:
    """Parities of twice as many words as `size` made into those of half the bits; others as they are."""
    return F.when(F.size(v) > size, F.zip_with(F.slice(v, F.lit(1), size), F.slice(v, size + 1, size), lambda x, y: x.bitwiseXOR(y))).otherwise(v)


def _verified(pairs: DataFrame, each: DataFrame, texts: DataFrame, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The pairs (a, b) whose sets have a likeness of 4/5 or more. Parities of the nodes that a pair asks for come from
    `each`; sets, for the few pairs that these leave open, are made again from their texts."""
    asking = lambda of: of.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    pairs = cut(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    asked = asking(pairs)
    known = _among(each.select("node", "h", "n", "wide"), asked, "node").groupBy("node").agg(F.min("h").alias("h"), F.min("n").alias("n"), F.first("wide").alias("wide"))
    known = cut(known.join(asked, "node", "left_semi"), "known")
    of = lambda c, w, n: known.select(F.col("node").alias(c), F.col("wide").alias(w), F.col("n").alias(n))
    words = F.least(F.size("v"), F.size("w"))
    apart = F.aggregate(F.zip_with(_folded(F.col("v"), words), _folded(F.col("w"), words), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    met = pairs.join(of("a", "v", "p"), "a").join(of("b", "w", "q"), "b").filter("5 * p >= 4 * q and 5 * q >= 4 * p")
    likely = met.select("a", "b", apart.alias("apart"), (F.col("p") + F.col("q")).alias("n"), (64 * words).alias("bits"))
    likely = cut(likely.filter(9 * F.col("apart") <= F.col("n")).select("a", "b", _sure(F.col("apart"), F.col("n"), F.col("bits")).alias("sure")), "likely")
    open_ = likely.filter("not sure").select("a", "b")
    if open_.isEmpty():
        return likely.select("a", "b")
    asked = asking(open_).join(known.select("node", "h"), "node")
    sets = _sets(_among(texts.select("h", "text"), asked, "h")).groupBy("h").agg(F.first("found").alias("found"))
    sets = cut(sets.join(asked, "h").select("node", "found"), "sets")
    side = lambda c, s: sets.select(F.col("node").alias(c), F.col("found").alias(s))
    both = F.size(F.array_intersect("x", "y"))
    close = open_.join(side("a", "x"), "a").join(side("b", "y"), "b").filter(9 * both >= 4 * (F.size("x") + F.size("y"))).select("a", "b")
    return cut(likely.filter("sure").select("a", "b").unionByName(close), "links")


def _fingerprint_pairs(nodes: DataFrame, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(a, b): nodes whose fingerprints are equal, each with the first of them, and firsts whose fingerprints Golay keys
    bring together within 2 bits."""
    some = nodes.filter(F.col("n") > 0).select("node", "print")
    firsts = cut(some.groupBy("print").agg(F.min("node").alias("rep")), "prints")
    equal = some.join(firsts, "print").filter(F.col("node") != F.col("rep")).select(F.col("rep").alias("a"), F.col("node").alias("b"))
    near = golay.links(firsts, keep=cut).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return equal.unionByName(near).distinct()


def groups(documents: DataFrame) -> DataFrame:
    """(doc_id, h, component): one row per row of documents, with the 64-bit hash of its text and its group. Texts link at
    a Jaccard likeness of 0.8 or more of their shingles; a group is what links reach. Texts without words are one group."""
    texts = _texts(documents)
    with scratch(documents.sparkSession) as cut:
        each = cut(_described(texts, _common(texts)), "described")
        nodes = cut(each.groupBy("node").agg(F.min("h").alias("h"), *[F.min(c).alias(c) for c in ("n", "print", *_MAPS)]), "nodes")
        links = _verified(_fingerprint_pairs(nodes, cut), each, texts, cut)
        found = cut(components(links, cut).withColumnRenamed("node", "__node"), "found")
        release(documents.sparkSession)
        firsts = _placed(each.groupBy("node").agg(F.first("keys").alias("keys")), found)
        keyed = cut(firsts.select("node", "component", F.explode("keys").alias("key")), "keyed")
        spread = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter(F.col("lo") != F.col("hi"))
        held = keyed.select("node", "key").join(spread.select("key", "members"), "key")
        held = cut(held.join(nodes.select("node", "n", *_MAPS), "node"), "held")
        for turn in range(HUB_ROUNDS + 1):
            release(documents.sparkSession)
            live = _placed(held, found)
            crowded = live.filter(F.col("members") > BUCKET)
            pairs = _hub_pairs(crowded, turn) if turn < HUB_ROUNDS else _all_pairs(crowded)
            if turn == 0:
                pairs = pairs.unionByName(_all_pairs(live.filter(F.col("members") <= BUCKET))).distinct()
            more = _verified(pairs, each, texts, cut)
            release(documents.sparkSession)
            if not more.isEmpty():
                links = links.unionByName(more)
                found = cut(components(links, cut).withColumnRenamed("node", "__node"), "found")
        return materialize(_placed(each.select("doc_id", "h", "node"), found).select("doc_id", "h", "component"), "groups")


def _placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the component of their node; a node that nothing links is one by itself."""
    return rows.join(found, rows["node"] == found["__node"], "left").withColumn("component", F.coalesce("component", "node")).drop("__node")


def keep_one(documents: DataFrame) -> DataFrame:
    """documents with one row of each group: that of the smallest doc_id and, among rows that repeat it, of the smallest
    hash of the text; of rows that are equal in both, any one. Rows with a null id stay, each.

    Null, empty and blank texts are alike. Whole texts count, however long. Other columns stay as they are; names that begin
    with __kept_ are this function's own. Texts are shuffled once: what is made distinct is so by the keys of the join."""
    rows = groups(documents).filter(F.col("doc_id").isNotNull())
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    chosen = materialize(first.select(F.col("first.doc_id").alias("__kept_id"), F.col("first.h").alias("__kept_h")), "chosen")
    own = documents.withColumns({"__kept_row": F.col("doc_id").cast("bigint"), "__kept_own": F.xxhash64(F.col("text").cast("string"))})
    kept = own.join(chosen, (F.col("__kept_row") == F.col("__kept_id")) & (F.col("__kept_own") == F.col("__kept_h")), "left_semi").dropDuplicates(["__kept_row", "__kept_own"])
    return kept.select(*[F.col(f"`{c}`") for c in documents.columns]).unionByName(documents.filter(F.col("doc_id").isNull()))
