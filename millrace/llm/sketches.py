"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a text's shingles. Sketches of parts merge
into the sketch of the whole, and two sketches estimate resemblance, containment and distinct counts. Everything here is
a Column expression, so a sketch is made inside the scan's own stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, window_hashes, words

K = 64
WIDTH = 5


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """Bottom-k sketch of a whole text. Fewer words than `width` make one shingle of them all; no word, an empty sketch."""

    def hashes(ws: Column) -> Column:
        return F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).when(F.size(ws) < width, F.array(F.xxhash64(F.array_join(ws, " ")))).otherwise(window_hashes(ws, width))

    return F.slice(F.sort_array(F.array_distinct(let(words(text), hashes))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what a and b were made of."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, keys: list[str], sketch_column: str, k: int = K) -> DataFrame:
    """One merged sketch per group, by a distinct count of at most k hashes a group and partition: the k smallest hashes
    of each group are found by a ranked window over distinct (key, hash) rows, never by gathering a group's sketches."""
    from pyspark.sql import Window

    rows = df.select(*keys, F.explode(sketch_column).alias("__h")).distinct()
    salted = rows.withColumn("__salt", F.pmod(F.col("__h"), F.lit(64)))
    part = salted.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy("__h"))).filter(F.col("__r") <= k)
    whole = part.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("__h"))).filter(F.col("__r") <= k)
    return whole.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(sketch_column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the part of the union's k smallest hashes that both hold. Two empty sketches: 1."""
    return let(F.struct(a.alias("a"), b.alias("b"), merge(a, b, k).alias("u")), lambda s: F.when(F.size(s["u"]) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(s["a"], s["b"]), s["u"])) / F.size(s["u"])))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact while there are fewer than k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b holds too; 1 for an empty a."""
    j = resemblance(a, b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (distinct_count(a, k) + distinct_count(b, k)) / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """16 lowercase hex digits for each hash, in ascending order of the hashes."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


#: Ids are put in order block by block; a block has about this many, and there are at most MOST_BLOCKS blocks, which
#: bounds the table of block ends that the driver sees and broadcasts.
BLOCK_IDS, MOST_BLOCKS = 50_000, 4_096
#: Stands for a null id: the smallest of all.
_NO_ID = -(2**63)


def neighbours(ids: DataFrame) -> DataFrame:
    """(key, prev_key, prev_chars) from distinct (key, chars): for each document the one that has it as its next. The next
    is the next smaller key; that of the smallest is the largest. Only keys and lengths take part: blocks between
    explicit bounds are put in order on their own, and each takes one row from the block above it."""
    from pyspark.sql import Window

    spark = ids.sparkSession
    blocks = min(MOST_BLOCKS, max(1, ids.count() // BLOCK_IDS))
    cuts = sorted({int(c) for c in ids.approxQuantile("key", [i / blocks for i in range(1, blocks)], 0.2 / blocks)}) if blocks > 1 else []
    block = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    ordered = ids.withColumn("block", block)
    ends = sorted(tuple(r) for r in ordered.groupBy("block").agg(F.min("key"), F.min_by("chars", "key")).collect())
    if not ends:
        return ids.select("key", F.col("key").alias("prev_key"), F.col("chars").alias("prev_chars"))
    # the first of a block follows the last (smallest) of the block above; the very first follows the smallest of all
    above = [(b, *(ends[(k + 1) % len(ends)] if k + 1 < len(ends) else ends[0])[1:]) for k, (b, _, _) in enumerate(ends)]
    carried = spark.createDataFrame(above, "block int, above_key bigint, above_chars int")
    inside = Window.partitionBy("block").orderBy(F.desc("key"))
    return (
        ordered.select("*", F.lag("key").over(inside).alias("p"), F.lag("chars").over(inside).alias("c"))
        .join(F.broadcast(carried), "block")
        .select("key", F.coalesce("p", "above_key").alias("prev_key"), F.coalesce("c", "above_chars").alias("prev_chars"))
    )


def fingerprints_of_edits(documents: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, the estimated number of
    distinct shingles and the next document's id, one row per row of documents.

    The edited text has the last floor(n_chars/3) code points replaced by as many from the start of the next document (by
    descending id; after the last, the first). A null text is empty, a null id is smaller than any other. Rows that
    repeat an id are returned each; as the next of others, the smallest of their texts counts. Equal hashes are one shingle.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    docs = documents.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    ids = materialize(docs.groupBy("key").agg(F.max(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("rows")), "ids")
    links = materialize(neighbours(ids.select("key", "chars")), "links")
    heads = docs.join(links, "key").select(F.col("prev_key").alias("key"), F.substring("text", F.lit(1), F.floor(F.col("prev_chars") / 3).cast("int")).alias("head"), sketch(F.col("text"), k, width).alias("next_sketch"), "text", F.col("doc_id").alias("next_id"))
    if ids.filter(F.col("rows") > 1).limit(1).count():
        heads = heads.groupBy("key").agg(F.min(F.struct("text", "head", "next_sketch", "next_id")).alias("x")).select("key", "x.head", "x.next_sketch", "x.next_id")
    both = docs.join(heads.select("key", "head", "next_sketch", "next_id"), "key")  # both joins read one shuffle of the same columns
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    both = both.select("doc_id", n.alias("n_chars"), "text", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("head", F.lit(1), cut)).alias("edited"), "next_sketch", "next_id")
    made = both.select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("text"), k, width).alias("a"), sketch(F.col("edited"), k, width).alias("b"), "next_sketch", "next_id")
    return made.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("b"), k).alias("near_edited"), resemblance(F.col("a"), F.col("next_sketch"), k).alias("near_next"), distinct_count(F.col("a"), k).alias("n_shingles"), "next_id",
    )
