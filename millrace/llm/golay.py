"""SimHash near-duplicates with fuzzy keys from the binary Golay code.

The (23,12) Golay code is perfect: every 23-bit word lies within 3 bits of one codeword. A word at distance 3 from its
codeword lies at distance 4 from five others, any other word from none; so the codewords within 4 bits are 1 or 6, and
two words that differ in at most 2 bits always share one. A 64-bit fingerprint is cut into three segments. If two
fingerprints differ in at most 2 bits, one segment at least is the same (pigeonhole), and the segment after it differs in
at most 2 bits: a key of an exact segment and one codeword index of the next finds every such pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, tidy
from .components import components

#: Generator polynomial of the code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
DISTANCE = 2
#: Up to so many fingerprints that share a key are compared in pairs; larger groups are linked through shared
#: one-bit neighbours, which is as exact and takes 65 rows a fingerprint.
BUCKET = 16
SEED = 42


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    r = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ np.uint32(GENERATOR << (bit - 11)), r)
    return r


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of up to 4 bits that give it: masks [2048, 6] and how many there are."""
    errors = np.array([sum(1 << b for b in c) for n in range(5) for c in combinations(range(23), n)], dtype=np.uint32)
    masks, count = np.zeros((2048, 6), np.uint32), np.zeros(2048, np.int64)
    for e, s in zip(errors.tolist(), _syndromes(errors).tolist(), strict=True):
        masks[s, count[s]] = e
        count[s] += 1
    return masks, count


_tables: list = []


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within 4 bits of each word: [n, 6], and which of them count."""
    if not _tables:
        _tables.extend(_patterns())
    masks, count = _tables
    s = _syndromes(words)
    return (words.astype(np.uint32)[:, None] ^ masks[s]) >> 11, np.arange(6) < count[s][:, None]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for unsigned 64-bit fingerprints: an exact segment, a codeword index of the next, and which segment."""
    cut = [(prints >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
    rows, keys = [], []
    for k in range(3):
        index, valid = codewords(cut[(k + 1) % 3])
        key = (cut[k].astype(np.int64)[:, None] << 14) | (index.astype(np.int64) << 2) | k
        at = np.nonzero(valid)
        rows.append(at[0])
        keys.append(key[at])
    return np.concatenate(rows), np.concatenate(keys)


def simhash(text: str | None, width: int = 3) -> int:
    """Fingerprint of a whole text: bit b is set if it is set in over half of the shingles' hashes, repeats included.
    A-Z are lower-cased; fewer words than `width` make one shingle; no word gives 0."""
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins[: len(ws) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(ws) - width + 1)
    return majority(h)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of unsigned hashes: a bit is set if it is set in over half of them."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        total += np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, print): the signed 64-bit form of each row's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((simhash(x.as_py(), width) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "print"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda b: tidy(run(b)), "doc_id bigint, print bigint")


def _keyed(prints: DataFrame) -> DataFrame:
    """(rep, print, key) of distinct (rep, print)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(1).to_numpy(zero_copy_only=False)
            rows, keys = fuzzy_keys(p.view(np.uint64))
            reps = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(reps[rows]), pa.array(p[rows]), pa.array(keys)], ["rep", "print", "key"])

    return prints.select("rep", "print").mapInArrow(lambda b: tidy(run(b)), "rep bigint, print bigint, key bigint")


def links(prints: DataFrame, bucket: int = BUCKET, keep: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """(a, b): links that join all distinct (rep, print) within DISTANCE bits as whole groups. Small groups of a key give
    their verified pairs. Members of larger ones are tied to the smallest rep among those that share a neighbour at one
    bit or less with them: two fingerprints share one exactly if they differ in at most 2 bits."""
    keyed = _keyed(prints)
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    held = keep(keyed.join(counts, "key"), "keyed")
    small = held.filter(F.col("n") <= bucket)
    other = small.select("key", F.col("rep").alias("rep2"), F.col("print").alias("print2"))
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("print2"))) <= DISTANCE
    pairs = small.join(other, "key").filter((F.col("rep") < F.col("rep2")) & near).select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    crowded = held.filter(F.col("n") > bucket).select("rep", "print").distinct()
    masks = [0, *[1 << b for b in range(63)], -(1 << 63)]
    flips = F.transform(F.lit(masks), lambda m: F.col("print").bitwiseXOR(m))
    stars = crowded.select("rep", F.explode(flips).alias("at")).groupBy("at").agg(F.collect_list("rep").alias("reps")).filter(F.size("reps") > 1)
    starred = stars.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).filter(F.col("a") != F.col("b"))
    return pairs.unionByName(starred)


def near_duplicates(documents: DataFrame, width: int = 3, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of documents.

    Fingerprints link at DISTANCE or fewer bits; component_id is the smallest doc_id that a document reaches, itself
    included. Texts without words, null ones too, have fingerprint 0 and link like any other. Copies share a fingerprint
    and are one node from then on, so a group of copies costs no pairs. A row with a null id keeps its fingerprint and
    takes the component of its equals, if one of them has an id, else null. Empty tables give no rows."""
    with scratch(documents.sparkSession) as cut:
        each = cut(fingerprints(documents, width), "prints")
        prints = cut(each.groupBy("print").agg(F.min("doc_id").alias("rep")), "distinct")
        found = components(links(prints.filter(F.col("rep").isNotNull()), bucket, cut), cut)
        labels = prints.join(found, F.col("rep") == F.col("node"), "left").select("print", F.coalesce("component", "rep").alias("component_id"))
        made = each.join(labels, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
        return materialize(made, "near_duplicates")
