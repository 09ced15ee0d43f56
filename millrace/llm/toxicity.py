"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each model sees, besides the terms of a text, the probabilities of the
categories before it. In training those are out-of-fold, so that a later model learns from probabilities as uncertain as
those it will meet.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import release
from .common import crc_mod3, tidy
from .labelled import labelled_sample

#: At most so many labelled documents of each class are learned from, and so many terms are kept for each category; where the
#: sample is small, one term for every ROWS_A_TERM of its documents. Terms in one document alone say nothing.
PER_CLASS, TERMS, ROWS_A_TERM, USES = 4000, 400, 4, 3
FOLDS = 5
#: The fit spreads so many rows of the sample to doubles at a time; whole, the sample is a byte a term.
BLOCK = 500
RIDGE = 0.3
#: The chain's categories, from the columns of labels.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("toxic_prose", "toxic = 1 and quality = 1"))
LIMIT = 0.5
_LETTERS = re.compile(r"[^\W\d_]+")
_SHAPES = (("<marks>", re.compile(r"[^\w\s]{2}")), ("<bars>", re.compile(r" \| ")), ("<capitals>", re.compile(r"\b[^\W\d_a-zà-öø-ÿ]{3,}\b")))


def stems(word: str) -> tuple[str, ...]:
    """A word and its beginnings of 3 to 7 letters, which compounds of one stem share."""
    return (word, *(f"^{word[:k]}" for k in range(3, min(8, len(word)))))


def terms_of(text: str) -> set[str]:
    """Distinct runs of letters in lower case with their stems, and a few marks of a text's looks."""
    found = {t for w in set(_LETTERS.findall(text.lower())) for t in stems(w)}
    found.update(name for name, pattern in _SHAPES if pattern.search(text))
    return found


class Known:
    """The terms of a chain that texts have, as sorted indices; what a word gives is kept for the next text."""

    def __init__(self, index: dict[str, int]):
        self.index, self.memo = index, {}

    def __call__(self, text: str) -> list[int]:
        index, memo, found = self.index, self.memo, set()
        for w in set(_LETTERS.findall(text.lower())):
            got = memo.get(w)
            if got is None:
                if len(memo) > 300_000:
                    memo.clear()
                got = memo[w] = tuple(index[t] for t in stems(w) if t in index)
            if got:
                found.update(got)
        found.update(index[name] for name, pattern in _SHAPES if name in index and pattern.search(text))
        return sorted(found)


@dataclass
class Chain:
    names: list[str]
    terms: dict[str, int]
    weights: list[np.ndarray]  # of the terms, the probabilities before, and the intercept


def _blocks(parts: list[np.ndarray], rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """The given rows of arrays side by side, BLOCK at a time."""
    for k in range(0, len(rows), BLOCK):
        yield slice(k, k + BLOCK), np.hstack([p[rows[k : k + BLOCK]] for p in parts], dtype=np.float64)


def logistic(x: np.ndarray | list[np.ndarray], y: np.ndarray, ridge: float, rounds: int = 30, rows: np.ndarray | None = None) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last column of x is the intercept's. Both classes
    weigh alike, however rare one is. x may come as arrays side by side, of any kinds of numbers, and with rows only those
    count; a few rows at a time are spread to doubles."""
    parts = x if isinstance(x, list) else [x]
    rows = np.arange(len(y)) if rows is None else rows
    y, width = y[rows], sum(p.shape[1] for p in parts)
    w, share = np.zeros(width), min(max(y.mean(), 1e-3), 1 - 1e-3)
    each = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))
    held = np.full(width, ridge)
    held[-1] = 1e-6
    for _ in range(rounds):
        gradient, curve = held * w, np.diag(held)
        for at, block in _blocks(parts, rows):
            p = 1 / (1 + np.exp(-np.clip(block @ w, -30, 30)))
            gradient += block.T @ (each[at] * (p - y[at]))
            block *= np.sqrt(np.maximum(each[at] * p * (1 - p), 1e-9))[:, None]
            curve += block.T @ block
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def fit_chain(x: np.ndarray, targets: np.ndarray, folds: np.ndarray, ridge: float = RIDGE) -> list[np.ndarray]:
    """One weight vector a category, in the chain's order. x: terms; targets [n, categories]; folds: a number per row."""
    n = len(x)
    earlier, weights = np.zeros((n, 0)), []
    for c in range(targets.shape[1]):
        full = [x, earlier, np.ones((n, 1))]
        weights.append(logistic(full, targets[:, c], ridge))
        unseen = np.full(n, targets[:, c].mean())
        for f in range(FOLDS):
            out = folds == f
            if out.any() and not out.all():
                w, rows = logistic(full, targets[:, c], ridge, rows=np.nonzero(~out)[0]), np.nonzero(out)[0]
                for at, block in _blocks(full, rows):
                    unseen[rows[at]] = _sigmoid(block @ w)
        earlier = np.hstack([earlier, unseen[:, None]])
    return weights


def chain_scores(chain: Chain, present: list[list[int]]) -> np.ndarray:
    """Probabilities [n, categories] from the known terms of each text."""
    n, t = len(present), len(chain.terms)
    out = np.zeros((n, 0))
    for w in chain.weights:
        terms = w[:t]
        own = np.fromiter((terms[p].sum() for p in present), np.float64, n)
        out = np.hstack([out, _sigmoid(own + out @ w[t:-1] + w[-1])[:, None]])
    return out


def learn(documents: DataFrame, labels: DataFrame, categories=CATEGORIES, per_class: int = PER_CLASS, most_terms: int = TERMS, train_all: bool = True) -> Chain | None:
    """The chain, from at most 2 * per_class labelled rows; None without any. Rows of labels whose categories a null leaves
    open are not learned from. Terms are ranked by how far their use differs between a category and the rest, and the ridge
    does the shrinking. train_all=False keeps the third of the ids with crc32 modulo 3 equal to 1 out, to measure by."""
    marked = labels.select("doc_id", *[F.expr(rule).cast("int").alias(f"is_{name}") for name, rule in categories])
    names = [name for name, _ in categories]
    lead = "is_toxic" if "toxic" in names else f"is_{names[-1]}"
    where = F.lit(True) if train_all else crc_mod3(F.col("doc_id")) != 1
    sample = labelled_sample(documents, marked, lead, where, per_class, tuple(f"is_{n}" for n in names if f"is_{n}" != lead))
    sample = sample.select("doc_id", "text", *[f"is_{n}" for n in names])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            marks = list(zip(*(batch.column(2 + k).to_pylist() for k in range(len(names))), strict=True))
            for text, mark in zip(batch.column(1).to_pylist(), marks, strict=True):
                for term in terms_of(text):
                    seen[term, -1] += 1
                    for c, m in enumerate(mark):
                        if m:
                            seen[term, c] += 1
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["term", "category", "n"])

    n_all = sample.agg(F.count(F.lit(1)), *[F.sum(f"is_{n}") for n in names]).first()
    if not n_all[0]:
        return None
    found = sample.mapInArrow(lambda b: tidy(count(b)), "term string, category int, n bigint").groupBy("term").agg(*[F.sum(F.when(F.col("category") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(-1, len(names))])
    terms: set[str] = set()
    for c in range(len(names)):
        total, own = float(n_all[0]), float(n_all[c + 1] or 0)
        if not 0 < own < total:
            continue
        a, every = F.col(f"n{c}").cast("double"), F.col("`n-1`").cast("double")
        gap = a / own - (every - a) / (total - own)
        spread = (every / total) * (1 - every / total) * (1 / own + 1 / (total - own))
        z2 = F.when(spread > 0, gap * gap / spread).otherwise(0.0)
        most = max(1, min(most_terms, n_all[0] // ROWS_A_TERM))
        best = found.filter(F.col("`n-1`") >= USES).select("term", z2.alias("z2")).orderBy(F.desc("z2"), "term").limit(most)
        terms |= {r["term"] for r in best.collect()}
    index = {t: k for k, t in enumerate(sorted(terms))}

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_terms = Known(index)
        for batch in batches:
            rows = [known_terms(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32())), *batch.columns[2:]], ["doc_id", "present", *[f"is_{n}" for n in names]])

    kind = "doc_id bigint, present array<int>, " + ", ".join(f"is_{n} int" for n in names)
    table = sample.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *[f"is_{n}" for n in names]).mapInArrow(lambda b: tidy(known(b)), kind).orderBy("doc_id").toArrow()
    x = np.zeros((table.num_rows, len(index)), np.uint8)
    present = table.column("present").combine_chunks()
    x[np.repeat(np.arange(len(x)), np.diff(present.offsets.to_numpy())), present.flatten().to_numpy()] = 1
    targets = np.array([table.column(f"is_{n}").to_pylist() for n in names], np.float64).T
    folds = np.array([zlib.crc32(f"fold {d}".encode()) % FOLDS for d in table.column("doc_id").to_pylist()])
    del table, present
    release(documents.sparkSession)
    return Chain(names, index, fit_chain(x, targets, folds))


def _probabilities(chain: Chain | None, known: Known | None, texts: list, width: int) -> np.ndarray:
    return np.zeros((len(texts), width)) if chain is None else chain_scores(chain, [known(x or "") for x in texts])


def _rejects(p: np.ndarray, names: list[str], limit: float) -> np.ndarray:
    """Whether a category whose name begins with toxic is likelier than the limit."""
    return (p[:, [k for k, n in enumerate(names) if n.startswith("toxic")]] > limit).any(axis=1)


def score(documents: DataFrame, labels: DataFrame, categories=CATEGORIES, limit: float = LIMIT, **options) -> DataFrame:
    """doc_id, p_<category> for each, toxic: one row per row of documents. toxic: a category named toxic... is likelier
    than the limit, and not only as likely. Null and empty texts have no terms and take the intercepts' probabilities;
    without labelled rows every probability is 0 and nothing is toxic. Repeated rows are scored each, whole texts count, other
    columns are ignored, and an empty table gives no rows."""
    names = [n for n, _ in categories]
    shared = documents.sparkSession.sparkContext.broadcast(learn(documents, labels, categories, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        known = Known(chain.terms) if chain else None
        for batch in batches:
            p = _probabilities(chain, known, batch.column(1).to_pylist(), len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, c].copy()) for c in range(len(names))), pa.array(_rejects(p, names, limit))], ["doc_id", *(f"p_{n}" for n in names), "toxic"])

    kind = ", ".join(["doc_id bigint", *(f"p_{n} double" for n in names), "toxic boolean"])
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda b: tidy(run(b)), kind)


def drop_toxic(documents: DataFrame, labels: DataFrame, categories=CATEGORIES, limit: float = LIMIT, **options) -> DataFrame:
    """documents without the toxic ones, in one pass after the fit; all other columns stay as they are, whatever their names.
    Null and empty texts are judged by the intercepts."""
    names = [n for n, _ in categories]
    shared = documents.sparkSession.sparkContext.broadcast(learn(documents, labels, categories, **options))
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        known = Known(chain.terms) if chain else None
        for batch in batches:
            p = _probabilities(chain, known, batch.column(at).to_pylist(), len(names))
            yield batch.filter(pa.array(~_rejects(p, names, limit)))

    return documents.mapInArrow(lambda b: tidy(run(b)), documents.schema)
