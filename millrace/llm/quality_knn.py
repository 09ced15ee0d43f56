"""Quality by nearest-neighbour voting in a latent-semantic space.

A document is a bag of hashed words, word shapes and marks of repetition and length, weighted by tf-idf. A truncated SVD
of a bounded labelled sample gives the latent space; the sample's vectors go to all executors, every document's cosines
with all of them are computed in blocks, and the nearest vote with their similarity.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod3, tidy
from .labelled import labelled_sample

#: At most so many labelled documents of each class are learned from.
PER_CLASS = 3000
WORDS, SHAPES, MARKS = 2048, 1024, 128
RANK, NEIGHBOURS, SHARP = 64, 25, 6
ROWS = 512

_RUNS = (re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\W\d_a]+"), re.compile(r"\d+"), re.compile(r"([^\w])\1+"))
_memo: dict[str, tuple[int, int]] = {}


def shape(word: str) -> str:
    """Runs of lower-case letters as a, of other letters as A, of digits as 0, other characters once: `Of%%%` is `Aa%`."""
    lower, upper, digits, same = _RUNS
    return same.sub(r"\1", digits.sub("0", upper.sub("A", lower.sub("a", word))))


def _places(word: str) -> tuple[int, int]:
    got = _memo.get(word)
    if got is None:
        if len(_memo) > 300_000:
            _memo.clear()
        got = _memo[word] = (zlib.crc32(word.strip(".,;:!?").lower().encode()) % WORDS, WORDS + zlib.crc32(shape(word).encode()) % SHAPES)
    return got


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of a whole text and their raw weights; a text without words has only marks."""
    ws = text.split()
    n = len(ws)
    bag: Counter = Counter()
    for word, times in Counter(ws).items():
        a, b = _places(word)
        bag[a] += times
        bag[b] += times
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = max(n - 1, 1)
    ratios = (
        sum(map(eq, ws, ws[1:])) / pairs,
        1 - len(set(zip(ws, ws[1:], ws[2:], strict=False))) / max(n - 2, 1) if n > 2 else 0.0,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(map(str.isalpha, text)) / max(len(text), 1),
    )
    base = WORDS + SHAPES
    marks = [base + k * 16 + min(15, int(r * 16)) for k, r in enumerate(ratios)]
    marks.append(base + 64 + min(31, n.bit_length()))
    index = np.fromiter(bag, np.int64, len(bag))
    weight = 1 + np.log(np.fromiter(bag.values(), np.float64, len(bag)))
    return np.concatenate((index, marks)), np.concatenate((weight, np.ones(len(marks))))


def rows_of(bags: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """Dense tf-idf rows; words, shapes and marks are scaled to length 0.7, 1 and 0.7 each, so that none drowns the others."""
    out = np.zeros((len(bags), len(idf)), np.float32)
    for k, (index, weight) in enumerate(bags):
        out[k, index] = weight * idf[index]
    for a, b, size in ((0, WORDS, 0.7), (WORDS, WORDS + SHAPES, 1.0), (WORDS + SHAPES, len(idf), 0.7)):
        part = out[:, a:b]
        part *= size / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return out


@dataclass
class Model:
    idf: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def svd_space(x: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """The first right singular vectors, by a randomised range finder with power steps."""
    rng = np.random.default_rng(seed)
    y = x @ rng.standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(y)
        y = x @ (x.T @ q)
    q, _ = np.linalg.qr(y)
    return np.ascontiguousarray(np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T)


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK) -> Model:
    seen = np.zeros(WORDS + SHAPES + MARKS)
    for index, _ in bags:
        seen[np.unique(index)] += 1
    idf = np.log((1 + len(bags)) / (1 + seen)) + 0.1
    x = rows_of(bags, idf)
    space = svd_space(x, min(rank, *x.shape))
    return Model(idf, space, _unit(x @ space).astype(np.float32), labels.astype(np.float32), float(labels.mean()))


def vote(model: Model, texts: list[str], neighbours: int = NEIGHBOURS, rows: int = ROWS) -> np.ndarray:
    """Scores from 0 to 1. Each block of documents meets every labelled vector. Of labelled vectors that are equally near at
    the last place, any may vote; all that are counted weigh by their cosine, so that equals weigh alike."""
    out = np.empty(len(texts))
    k = min(neighbours, len(model.vectors))
    for at in range(0, len(texts), rows):
        z = _unit(rows_of([features(t) for t in texts[at : at + rows]], model.idf) @ model.space)
        cosine = z @ model.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-3).astype(np.float64) ** SHARP
        out[at : at + rows] = (weight * model.labels[near]).sum(axis=1) / weight.sum(axis=1)
    return np.clip(out, 0.0, 1.0)


def learn(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """A model from at most 2 * per_class labelled rows outside the held-out third; None if there are none of them. Texts
    become bags of features where they lie; the driver sees at most WORDS + SHAPES + MARKS numbers for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [features(x) for x in batch.column(1).to_pylist()]
            kinds = ((0, pa.int16()), (1, pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([b[k] for b in bags], pa.list_(kind)) for k, kind in kinds)], ["doc_id", "quality", "places", "weights"])

    sample = labelled_sample(documents, labels, "quality", crc_mod3(F.col("doc_id")) != 1, per_class).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("quality").cast("int").alias("quality"))
    table = sample.mapInArrow(lambda b: tidy(run(b)), "doc_id bigint, quality int, places array<smallint>, weights array<float>").orderBy("doc_id").toArrow()
    if not table.num_rows:
        return None
    flat = lambda c: (table.column(c).combine_chunks().flatten().to_numpy(), table.column(c).combine_chunks().offsets.to_numpy())
    (places, ends), (weights, _) = flat("places"), flat("weights")
    ends = ends - ends[0]
    bags = [(places[a:b].astype(np.int64), weights[a:b].astype(np.float64)) for a, b in zip(ends, ends[1:], strict=False)]
    return fit(bags, table.column("quality").to_numpy().astype(np.float64))


def score(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of documents.

    Null and empty texts are scored by what their marks are near to. Without any labelled row to learn from, every score
    is 0.5. A null id is not held out. Rows that repeat are scored each, whole texts count, and other columns are ignored. An
    empty table gives no rows."""
    model = learn(documents, labels, per_class)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            made = np.full(len(texts), 0.5) if shared.value is None else vote(shared.value, texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made), pa.array((made >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    read = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), (crc_mod3(F.col("doc_id")) == 1).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return read.mapInArrow(lambda b: tidy(run(b)), "doc_id bigint, held_out boolean, score double, predicted int")
