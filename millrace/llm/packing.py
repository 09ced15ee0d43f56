"""Packing token sequences by non-negative least squares over length patterns.

Only the histogram of piece lengths (one row a length) is seen by the driver. A pattern is one, two or three lengths that
together fill a sequence (a single length may leave room). Repeat counts are fitted to the histogram by accelerated
projected gradient, rounded down, and what they leave over is packed best-fit: the longest length left, then whatever
fits the gap best, as often as the counts allow. The plan says which ranks of a length go to which sequences at which
offset; its size depends on the length limit alone. Pieces get their ranks in a distributed way and look their place up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, tidy
from .transducer import Pretokens, blocks, run_places, split_special

LIMIT = 1024
#: Spellings that a worker keeps, and bytes of them; beyond, it begins again.
_POOL_MOST, _BYTES_MOST = 800_000, 1 << 25
#: Spellings that the library is given at once: its answers take some hundred times their bytes.
_AT_ONCE = 4096


class _Runs:
    """Runs of numbers, one after the other: run n is of[at[n] : at[n + 1]]."""

    def __init__(self, kind: str):
        self.of, self.at, self.count = np.empty(1 << 16, kind), np.zeros(1 << 16, np.int64), 0

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        n, held = self.count, int(self.at[self.count])
        self.at, self.of = _roomy(self.at, n + 1, n + len(sizes) + 1), _roomy(self.of, held, held + len(values))
        self.of[held : held + len(values)] = values
        self.at[n + 1 : n + len(sizes) + 1] = held + np.cumsum(sizes)
        self.count += len(sizes)

    def sizes(self, which: np.ndarray) -> np.ndarray:
        return self.at[which + 1] - self.at[which]

    def take(self, which: np.ndarray) -> np.ndarray:
        return self.of[run_places(self.at[which], self.sizes(which))]


def _roomy(values: np.ndarray, used: int, size: int) -> np.ndarray:
    """values with room for `size`; what isn't used yet is not written either, and so takes no memory."""
    if len(values) >= size:
        return values
    more = np.empty(max(2 * len(values), size), values.dtype)
    more[:used] = values[:used]
    return more


class Encoder:
    """Token ids of many texts. The library encodes each spelling of a pre-token once; texts are put together from those.

    Known spellings are kept in arrays, some 65 bytes each, and not as objects, as every worker of an executor holds its own:
    their hashes in order with the number of each, and the bytes and ids by number. Bytes are compared before a hash counts."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = {x.content: i for i, x in self.library.get_added_tokens_decoder().items()}
        self._forget()

    def _learn(self, spellings: list[bytes]) -> None:
        made = self.library.encode_batch_fast([w.decode() for w in spellings], add_special_tokens=False)
        ids, n = [x.ids for x in made], len(spellings)
        self.ids.add(np.fromiter(chain.from_iterable(ids), "<u4"), np.fromiter(map(len, ids), np.int64, n))
        self.bytes.add(np.frombuffer(b"".join(spellings), np.uint8), np.fromiter(map(len, spellings), np.int64, n))

    def _forget(self) -> None:
        self.hash, self.number = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.bytes, self.ids = _Runs("u1"), _Runs("<u4")

    def _numbers(self, found: Pretokens, one: np.ndarray) -> np.ndarray:
        """The number of each spelling; new ones are learned. What only shares a hash with another is learned each time."""
        begin, length = found.begin[one], found.length[one]
        number, held = np.full(len(one), -1, np.int64), np.zeros(len(one), bool)
        at = np.searchsorted(self.hash, found.hash)
        if len(self.hash):
            near = np.minimum(at, len(self.hash) - 1)
            there = np.flatnonzero(self.hash[near] == found.hash)
            held[there] = True
            known = self.number[near[there]].astype(np.int64)
            same = length[there] == self.bytes.sizes(known)
            there, known = there[same], known[same]
            apart = np.flatnonzero(found.bytes[run_places(begin[there], length[there])] != self.bytes.take(known))
            number[there] = known
            number[there[np.searchsorted(np.cumsum(length[there]), apart, side="right")]] = -1
        new = np.flatnonzero(number < 0)
        if new.size:
            number[new] = self.ids.count + np.arange(len(new))
            raw = found.bytes.tobytes()
            for k in range(0, len(new), _AT_ONCE):
                some = new[k : k + _AT_ONCE]
                self._learn([raw[b : b + n] for b, n in zip(begin[some].tolist(), length[some].tolist(), strict=True)])
            fresh = new[(new < len(found.hash)) & ~held[new]]
            self.number = np.insert(self.number, at[fresh], number[fresh])
            self.hash = np.insert(self.hash, at[fresh], found.hash[fresh])
        return number

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, special strings as the library takes them by default."""
        parts, of, extra = split_special(texts, list(self.special))
        if extra.any():
            for t, n in zip(texts, extra.tolist(), strict=True):
                yield np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4") if n else next(self.encode([t]))
            return
        for a, b in blocks(parts):
            yield from self._block(parts[a:b])

    def _block(self, texts: list[str]) -> Iterator[np.ndarray]:
        found = Pretokens(texts)
        one, which = found.distinct()
        if self.ids.count + len(one) > _POOL_MOST:
            self._forget()
        number = self._numbers(found, one)[which]
        total = np.concatenate(([0], np.cumsum(self.ids.sizes(number))))
        ids = self.ids.take(number)
        if self.bytes.at[self.bytes.count] > _BYTES_MOST:
            self._forget()
        for a, b in zip(total[found.first].tolist(), total[found.past].tolist(), strict=True):
            yield ids[a:b]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first of a longer document."""
    head = n % limit or limit
    return [(0, min(n, head)), *((s, limit) for s in range(head, n, limit))]


def pieces(documents: DataFrame, path: str, limit: int = LIMIT, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, rank: rank counts the pieces of one length within a part (one task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            rows = []
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(path).encode(texts), strict=True):
                raw = ids.astype("<u4").tobytes() + end_id.to_bytes(4, "little")
                for k, (s, n) in enumerate(cut(len(raw) // 4, limit)):
                    rows.append((doc, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)]), part, int(seen[n])))
                    seen[n] += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda b: tidy(run(b)), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint")


def patterns(limit: int) -> np.ndarray:
    """Every one, two or three lengths that fill `limit` exactly, and every single length: rows of ascending lengths, 0
    for none."""
    single = np.arange(1, limit + 1)
    a = np.arange(1, limit // 2 + 1)
    pairs = np.stack([np.zeros_like(a), a, limit - a], axis=1)
    i, j = np.meshgrid(np.arange(1, limit // 3 + 1), a, indexing="ij")
    k = limit - i - j
    good = (i <= j) & (j <= k)
    triples = np.stack([i[good], j[good], k[good]], axis=1)
    return np.concatenate([np.stack([0 * single, 0 * single, single], axis=1), pairs, triples])


def fit(histogram: np.ndarray, rows: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x with least |A x - histogram|^2, A[length, pattern] being how often a pattern has the length, where
    room left in a sequence weighs a little against the pattern. Nesterov's accelerated projected gradient."""
    limit = len(histogram) - 1
    goal = histogram.astype(float)
    goal[0] = 0
    if not goal.any():
        return np.zeros(len(rows))
    room = (limit - rows.sum(axis=1)) / limit
    flat = rows.reshape(-1)

    def ahead(x: np.ndarray) -> np.ndarray:
        y = np.bincount(flat, np.repeat(x, 3), limit + 1)
        y[0] = 0
        return y

    def back(r: np.ndarray) -> np.ndarray:
        return r[rows].sum(axis=1)

    v = np.ones(len(rows))
    for _ in range(20):
        v = back(ahead(v))
        norm = np.linalg.norm(v)
        v /= norm
    step, x, z, t = 1 / (1.05 * norm), np.zeros(len(rows)), np.zeros(len(rows)), 1.0
    price = 0.05 * room * goal.max()
    for _ in range(rounds):
        new = np.maximum(0, z - step * (back(ahead(z) - goal) + price))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / after * (new - x), new, after
    return x


def plan(histogram: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): ranks of a length that go to as many sequences in a row."""
    limit = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    used, out, sequence = np.zeros(limit + 1, np.int64), [], 0

    def put(lengths: list[int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for n in sorted(lengths, reverse=True):
            out.append((n, int(used[n]), times, sequence, offset))
            used[n] += times
            left[n] -= times
            offset += n
        sequence += times

    rows = patterns(limit)
    exact = rows[(rows.sum(axis=1) == limit)]
    x = np.floor(fit(histogram, rows)[rows.sum(axis=1) == limit] + 1e-6).astype(np.int64)
    for at in np.argsort(-x, kind="stable"):
        if not x[at]:
            break
        lengths = [int(n) for n in exact[at] if n]
        need = np.bincount(lengths, minlength=limit + 1)
        times = min(int(x[at]), int((left[need > 0] // need[need > 0]).min()))
        if times > 0:
            put(lengths, times)
    longest = limit
    while True:  # best fit: each turn uses up a length or a gap
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            break
        lengths, held, room = [longest], left.copy(), limit - longest
        held[longest] -= 1
        while room:
            # the best fill of the gap by two lengths, else by the longest that fits
            fits = np.flatnonzero(held[: room + 1])
            if not fits.size:
                break
            best = int(fits[-1])
            if best < room:
                others = room - fits
                two = fits[(others > 0) & (held[others] > (others == fits))]
                if two.size:
                    best = int(two[-1])
            lengths.append(best)
            held[best] -= 1
            room -= best
        need = np.bincount(lengths, minlength=limit + 1)
        put(lengths, int((left[need > 0] // need[need > 0]).min()))
    return out


def placed(parts: DataFrame, where: list[tuple[int, int, int, int, int]], limit: int) -> DataFrame:
    """pieces with their rank over all parts looked up in the plan."""
    table = np.array(sorted(where), np.int64).reshape(-1, 5)
    first = np.searchsorted(table[:, 0], np.arange(limit + 2))
    key = table[:, 0] * (1 << 44) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.searchsorted(key, n * (1 << 44) + r, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(table[at, 3] + r - table[at, 1]), pa.array(table[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    assert len(first) == limit + 2
    return parts.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(lambda b: tidy(run(b)), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack(documents: DataFrame, path: str, limit: int = LIMIT, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every row of documents.

    A null or empty text is the end id alone. Rows that repeat are packed each. Documents longer than `limit` tokens with
    their end id are cut, the first piece taking what is over. An empty table gives no rows; other columns are ignored."""
    made = materialize(pieces(documents, path, limit, end_id), "pieces")
    by_part = made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part")
    base = materialize(by_part.withColumn("base", F.sum("n").over(before) - F.col("n")), "ranks")
    histogram = np.zeros(limit + 1, np.int64)
    for row in base.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `limit` rows
        histogram[row["length"]] = row["n"]
    ranked = made.join(base.select("length", "part", "base"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    return placed(ranked, plan(histogram), limit)
