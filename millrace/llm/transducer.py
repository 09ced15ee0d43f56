"""Byte-level BPE tokenizers compiled to finite-state transducers.

Two deterministic machines in a row count a text's tokens.

The splitter reads classes of code points and marks where pre-tokens start. Its states are few, so a piece of text is a
map from each state it may be entered in to the state it is left in; the maps of fixed-size chunks are computed side by
side, composed by a parallel prefix scan, and give each chunk's true entry state for one more pass that emits the marks.

The merger reads the bytes of a pre-token. Each of its transitions says by how much the byte changes the number of
tokens of what was read, so the sum over a pre-token is its count. Its states stand for all that later bytes can depend
on: each suffix of what was read that may begin a longer token, the last token before that suffix, and how many tokens
fewer there are up to it. In byte-pair encoding the tokens of a prefix follow from one rule: the last token is the only
one whose pair with the last token before it stays as it is when encoded (checked against the library in the tests). The
machine is determinised as texts ask for transitions; a full table is dropped and begun again, which changes no result.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

# Classes of the splitter's input.
BREAK, SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, C_SINGLE, C_R, C_V, C_L, C_E = range(12)
# Its states: nothing pending; in a run; after white space that ends in a space or not; after an apostrophe that began a
# pre-token; after that and r, v or l.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_WHITE, AFTER_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(10)
STATES = 10
HERE, BEFORE = 1, 2
BREAK_CODE = 0x110000
# Unicode's White_Space.
WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point, and BREAK for the one past the last."""
    table = np.full(BREAK_CODE + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[list(WHITE_SPACE)] = WHITE
    for c, k in ((" ", SPACE), ("'", QUOTE), ("r", C_R), ("v", C_V), ("l", C_L), ("e", C_E), *((x, C_SINGLE) for x in "stmd")):
        table[ord(c)] = k
    table[BREAK_CODE] = BREAK
    return table


@lru_cache(1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and emitted marks[state, class]: a pre-token starts here, or started one code point before."""
    letters = (LETTER, C_SINGLE, C_R, C_V, C_L, C_E)
    run = {**{c: IN_LETTERS for c in letters}, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: IN_OTHERS}
    to, out = np.zeros((STATES, 12), np.uint8), np.zeros((STATES, 12), np.uint8)
    for c in range(12):
        begun = {BREAK: FRESH, SPACE: AFTER_SPACE, WHITE: AFTER_WHITE, QUOTE: AFTER_QUOTE}.get(c, run.get(c))
        for s in range(STATES):  # by default a new pre-token starts here
            to[s, c], out[s, c] = begun, HERE
        for s, kinds in ((IN_LETTERS, letters), (IN_NUMBERS, (NUMBER,)), (IN_OTHERS, (OTHER, QUOTE))):
            if c in kinds:
                to[s, c], out[s, c] = s, 0
        for s in (AFTER_SPACE, AFTER_WHITE):
            if c in (SPACE, WHITE):  # the run goes on
                out[s, c] = 0
            elif c != BREAK:  # its last character stands apart; a space joins what follows
                to[s, c], out[s, c] = (run[c], BEFORE) if s == AFTER_SPACE else (begun, BEFORE | HERE)
        if c in (OTHER, QUOTE):
            to[AFTER_QUOTE, c], out[AFTER_QUOTE, c] = IN_OTHERS, 0
        elif c == C_SINGLE:
            to[AFTER_QUOTE, c], out[AFTER_QUOTE, c] = FRESH, 0
        elif c in (C_R, C_V, C_L):
            to[AFTER_QUOTE, c], out[AFTER_QUOTE, c] = {C_R: QUOTE_R, C_V: QUOTE_V, C_L: QUOTE_L}[c], 0
        for s, wanted in ((QUOTE_R, C_E), (QUOTE_V, C_E), (QUOTE_L, C_L)):
            if c == wanted:
                to[s, c], out[s, c] = FRESH, 0
            else:  # no contraction: the letter began a run of its own
                to[s, c], out[s, c] = to[IN_LETTERS, c], BEFORE | out[IN_LETTERS, c]
    return to, out


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Chunk maps [n, STATES] one after the other: where `then` leads from where `first` ends."""
    return np.take_along_axis(then, first.astype(np.int64), axis=1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """The composition of all maps up to and with each, in log2(n) rounds."""
    done, step = maps.copy(), 1
    while step < len(done):
        done[step:] = compose(done[:-step], done[step:])
        step *= 2
    return done


def split_marks(codes: np.ndarray, chunk: int = 512) -> np.ndarray:
    """For code points that begin and end with BREAK_CODE: True where a pre-token starts (and at every break)."""
    to, out = splitter()
    n = len(codes)
    kinds = np.full(-(-n // chunk) * chunk, BREAK, np.uint8)
    kinds[:n] = classes()[codes]
    steps = np.ascontiguousarray(kinds.reshape(-1, chunk).T)
    flat, wide = to.reshape(-1), 12
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (steps.shape[1], 1))
    for at, k in enumerate(steps):
        maps = flat[maps.astype(np.int16) * wide + k[:, None]]
        if at % 16 == 15 and (maps == maps[:, :1]).all():  # every map is constant by now: one lane a chunk is enough
            one = maps[:, 0]
            for rest in steps[at + 1 :]:
                one = flat[one.astype(np.int16) * wide + rest]
            maps = np.repeat(one[:, None], STATES, axis=1)
            break
    state = np.concatenate((np.zeros(1, np.uint8), prefix_scan(maps)[:-1, FRESH]))
    marks, emitted = np.empty_like(steps), out.reshape(-1)
    for at, k in enumerate(steps):
        where = state.astype(np.int16) * wide + k
        marks[at], state = emitted[where], flat[where]
    marks = np.ascontiguousarray(marks.T).reshape(-1)
    starts = (marks & HERE).astype(bool)
    starts[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return starts[:n]


_rolling: list = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, those of its inverse, and a random number for each byte."""
    if not _rolling or len(_rolling[0]) < n:
        size, base = max(n, 1 << 20) + 1, 0x9E3779B97F4A7C15
        made = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (base, pow(base, -1, 1 << 64))]
        _rolling[:] = [*made, np.random.default_rng(7).integers(1, 2**63, 256, np.uint64)]
    power, inverse, noise = _rolling
    return power[:n], inverse, noise


def run_places(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of all runs, one run after the other."""
    ends = np.cumsum(length)
    return np.repeat(begin - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)


class Pretokens:
    """The pre-tokens of some texts: bytes of all, begin and length of each, and the text it is of."""

    def __init__(self, texts: list[str]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "\n".join(["", *texts, ""])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        breaks = np.concatenate(([0], np.cumsum(sizes + 1)))
        codes[breaks] = BREAK_CODE
        marks = split_marks(codes)
        codes[breaks] = 10
        wide = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        offset = np.concatenate(([0], np.cumsum(wide)))
        at = np.flatnonzero(marks)
        of_break = np.zeros(len(codes), bool)
        of_break[breaks] = True
        ends = np.append(at[1:], len(codes))
        real = ~of_break[at]
        at, ends = at[real], ends[real]
        self.bytes = np.frombuffer(joined.encode(), np.uint8)
        self.begin, self.length = offset[at], offset[ends] - offset[at]
        #: first pre-token of each text, and one past the last
        self.first = np.searchsorted(at, breaks[:-1] + 1)
        self.past = np.append(self.first[1:], len(at)) if len(texts) else self.first

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """One pre-token of each spelling, and which of those each pre-token is. Found by a rolling 64-bit hash; the bytes
        are compared afterwards, and whatever only shares a hash counts for itself. `hash` gets the hashes, ascending, of all
        spellings but the last, which are those that only share one."""
        power, inverse, noise = _powers(len(self.bytes))
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(noise[self.bytes] * power, dtype=np.uint64)))
        key = (run[self.begin + self.length] - run[self.begin]) * inverse[self.begin] + self.length.astype(np.uint64)
        self.hash, first, which = np.unique(key, return_index=True, return_inverse=True)
        like = first[which]
        at = run_places(self.begin, self.length)
        same = self.length == self.length[like]
        other = np.minimum(at + np.repeat(self.begin[like] - self.begin, self.length), len(self.bytes) - 1)
        wrong = np.flatnonzero(self.bytes[at] != self.bytes[other])
        if wrong.size:
            same[np.searchsorted(np.cumsum(self.length), wrong, side="right")] = False
        odd = np.flatnonzero(~same)
        which[odd] = len(first) + np.arange(len(odd))
        return np.concatenate((first, odd)), which

    def per_text(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[self.past] - total[self.first]


class Merger:
    """The merging machine of one vocabulary."""

    def __init__(self, path: str, most_states: int = 400_000):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        byte_of = _byte_characters()
        self.token = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        self.spelled = {i: t for t, i in self.token.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        vocab = model["vocab"]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.node, self.child, self.of_node = {b"": 0}, {}, [None]
        self.deep = [False]
        for t, i in self.token.items():
            at = 0
            for k in range(len(t)):
                self.deep[at] = True
                nxt = self.child.get((at, t[k]))
                if nxt is None:
                    nxt = self.child[at, t[k]] = len(self.of_node)
                    self.of_node.append(None)
                    self.deep.append(False)
                at = nxt
            self.of_node[at] = i
        self.fits: dict = {}
        self.most_states = most_states
        self.reset()

    def reset(self) -> None:
        start = array("i", (0, -1, 0)).tobytes()
        self.states, self.id = [start], {start: 0}
        self._room(1 << 16)
        self.used = 0

    def _room(self, slots: int) -> None:
        """An open-addressing table of transitions by state * 256 + byte."""
        self.slots, self.shift = slots, np.uint64(64 - slots.bit_length() + 1)
        self.key, self.to, self.change = np.full(slots, -1, np.int64), np.zeros(slots, np.int32), np.zeros(slots, np.int8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the empty slot where it would go."""
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        there = self.key[slot]
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
            there = self.key[slot[open_]]
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        return slot

    def _add(self, key: int, to: int, change: int) -> None:
        if 2 * self.used >= self.slots:
            held = self.key >= 0
            old = self.key[held], self.to[held], self.change[held]
            self._room(4 * self.slots)
            for k, t, c in zip(*(x.tolist() for x in old), strict=True):
                self._put(k, t, c)
        self._put(key, to, change)
        self.used += 1

    def _put(self, key: int, to: int, change: int) -> None:
        slot = ((key * 0x9E3779B97F4A7C15) & (1 << 64) - 1) >> int(self.shift)
        while self.key[slot] >= 0:
            slot = (slot + 1) & (self.slots - 1)
        self.key[slot], self.to[slot], self.change[slot] = key, to, change

    def encode(self, word: bytes) -> list[int]:
        """Token ids by the merges in order of rank, the leftmost first."""
        ids = [self.token[word[k : k + 1]] for k in range(len(word))]
        while len(ids) > 1:
            best = min(range(len(ids) - 1), key=lambda k: self.merges.get((ids[k], ids[k + 1]), (1 << 40,))[0])
            found = self.merges.get((ids[best], ids[best + 1]))
            if not found:
                break
            ids[best : best + 2] = [found[1]]
        return ids

    def stays(self, last: int, token: int) -> bool:
        """Whether the two tokens, one after the other, are what their bytes encode to."""
        key = (last + 1) << 20 | token
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            word = (b"" if last < 0 else self.spelled[last]) + self.spelled[token]
            got = self.fits[key] = self.encode(word) == ([token] if last < 0 else [last, token])
        return got

    def compile(self, state: int, byte: int) -> int:
        """Adds the transition of a state by a byte. A state lists (trie node of the suffix, last token before it, tokens
        up to it less tokens in all), the whole text read last of all with the empty suffix."""
        grown, last, less, held = [], None, 0, memoryview(self.states[state]).cast("i")
        for k in range(0, len(held), 3):
            nxt = self.child.get((held[k], byte))
            if nxt is None:
                continue
            token = self.of_node[nxt]
            if last is None and token is not None and self.stays(held[k + 1], token):
                last, less = token, held[k + 2] + 1  # the count up to the suffix, plus one
            if self.deep[nxt]:
                grown += (nxt, held[k + 1], held[k + 2])
        if last is None:
            raise ValueError("the vocabulary does not cover every byte")
        grown[2::3] = [f - less for f in grown[2::3]]
        key = array("i", (*grown, 0, last, 0)).tobytes()
        new = self.id.get(key)
        if new is None:
            new = self.id[key] = len(self.states)
            self.states.append(key)
        self._add(state << 8 | byte, new, less)
        return new

    def counts(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Number of tokens of each pre-token: all machines step side by side, the ended ones drop out."""
        if len(self.states) > self.most_states:
            self.reset()
        total = np.zeros(len(begin), np.int32)
        order = np.argsort(-length, kind="stable")
        begin, lengths = begin[order], length[order]
        live = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")
        state, acc = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int32)
        for t, n in enumerate(live.tolist()):
            index = state[:n] << 8 | data[begin[:n] + t]
            slot = self._slot(index)
            missing = np.flatnonzero(self.key[slot] < 0)
            if missing.size:
                for code in np.unique(index[missing]).tolist():
                    self.compile(code >> 8, code & 255)
                slot = self._slot(index)
            acc[:n] += self.change[slot]
            state[:n] = self.to[slot]
        total[order] = acc
        return total


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Code points that are worked on at once.
BLOCK = 1 << 20


def blocks(texts: list[str], block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `block` code points each; a longer text is a range of its own."""
    begin = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t) > block:
            yield begin, k
            begin, held = k, 0
        held += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def split_special(texts: list[str], special: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts parted at special strings: the parts, the text of each, and the number of special tokens of each text."""
    if not any(s in t for s in special for t in texts):
        return texts, np.arange(len(texts)), np.zeros(len(texts), np.int64)
    import re

    cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
    parts, of, extra = [], [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        p = cut.split(t)
        parts += p
        of += [k] * len(p)
        extra[k] = len(p) - 1
    return parts, np.array(of, np.int64), extra


def count_tokens(texts: list[str], machine: Merger) -> np.ndarray:
    parts, of, extra = split_special(texts, machine.special)
    each = np.zeros(len(parts), np.int64)
    for a, b in blocks(parts):
        found = Pretokens(parts[a:b])
        one, which = found.distinct()
        each[a:b] = found.per_text(machine.counts(found.bytes, found.begin[one], found.length[one])[which])
    return np.bincount(of, each, len(texts)).astype(np.int64) + extra if len(parts) else extra


_machines: dict[str, Merger] = {}


def machine(path: str) -> Merger:
    """One machine a worker: what a task compiled serves the next."""
    if path not in _machines:
        _machines[path] = Merger(path)
    return _machines[path]


def token_counts(documents: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of documents, in one narrow stage.

    Special strings in a text count as one token, as the library has it by default; a null text counts as empty and has
    no tokens; repeated rows are counted each, other columns are ignored, whatever their names, and an empty table gives no
    rows. Long texts are split by a prefix scan over chunks, in time near their length. `path` names a byte-level BPE file that each executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = count_tokens([x or "" for x in batch.column(1).to_pylist()], machine(path))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    return read.mapInArrow(lambda b: tidy(run(b)), "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
