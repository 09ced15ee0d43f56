"""Secret scans: fixed patterns, and candidate strings whose sliding-window entropy is high for their alphabet.

All of it is Column expressions. A window's entropy is log2(W) - (sum of n*log2(n) over its characters)/W; the sum is
carried along while the window slides, by the counts of the character that enters and the one that leaves.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# The patterns of the base kinds, the group whose length counts and the least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 24
#: Alphabets: name, pattern of a whole candidate, least entropy in bits per character of its best window. What mixes marks
#: with letters must have letters of either case and a digit, which paths and names seldom have.
CLASSES = (
    ("hex", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{24,}(?![0-9A-Za-z])", 3.0),
    ("base36", r"(?<![0-9A-Za-z])(?:[0-9a-z]{24,}|[0-9A-Z]{24,})(?![0-9A-Za-z])", 3.75),
    ("base64", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])", 4.0),
)
#: Candidates that hold one of these are no secrets: counting-up alphabets, placeholders, digests named as such.
ALLOWED = r"(?i)0123456789|abcdefghijk|qwertyuiop|example|placeholder|xxxxxx|000000|sha(?:1|256|384|512)-|^[0-9]+$|^[A-Za-z+/_=-]+$"


def prefix(values: Column, op: Callable[[Column, Column], Column], zero: Column, block: int = 128) -> Column:
    """op over all values before each place, beginning with zero; op is associative, values a lambda's variable. An array that
    grows is copied at every step, so the fold goes block by block and then over the blocks: long texts cost little more than
    in proportion."""

    def fold(part: Column) -> Column:
        return F.aggregate(part, F.struct(zero.alias("p"), F.slice(F.array(zero), 1, 0).alias("o")), lambda acc, x: F.struct(op(acc["p"], x).alias("p"), F.concat(acc["o"], F.array(acc["p"])).alias("o")))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda b: fold(F.slice(values, b * block + 1, block)))
    joined = let(parts, lambda ps: let(fold(F.transform(ps, lambda x: x["p"])), lambda tops: F.flatten(F.transform(ps, lambda x, k: F.transform(x["o"], lambda v: op(F.get(tops["o"], k), v))))))
    return F.when(F.size(values) > 0, joined).otherwise(F.slice(F.array(zero), 1, 0))


_FOUND = "array<struct<at:int,to:int,match:string,part:string>>"


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """The leftmost non-overlapping matches as an array of (at, to, match, part): code points from 0, end exclusive, the
    whole match and the given group. Text between the matches comes from split, so that sums of lengths give the places."""

    def spans(x: Column) -> Column:
        lengths = F.transform(x["m"], lambda m, i: F.length(F.get(x["s"], i)) + F.length(m))

        def placed(before: Column) -> Column:
            at = lambda i: F.get(before, i) + F.length(F.get(x["s"], i))
            return F.transform(x["m"], lambda m, i: F.struct(at(i).alias("at"), (at(i) + F.length(m)).alias("to"), m.alias("match"), F.get(x["g"], i).alias("part")))

        return let(lengths, lambda n: let(prefix(n, lambda a, b: a + b, F.lit(0)), placed))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"), F.split(text, pattern, -1).alias("s"))
    return F.when(text.rlike(pattern), let(found, spans).cast(_FOUND)).otherwise(F.array().cast(_FOUND))


def best_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of any run of `window` characters of an ASCII candidate that is as long. The
    counts of the window's characters are kept in a string, one character a count, that each step writes to in place."""
    gain = F.array(*[F.lit(0.0)] + [F.lit((n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0)) for n in range(window + 1)])  # gain[n]: from n-1 to n
    count = lambda counts, c: F.ascii(F.substring(counts, c + 1, F.lit(1))) - 48
    put = lambda counts, c, n: F.overlay(counts, F.char(n + 48), c + 1, F.lit(1))

    def fold(codes: Column) -> Column:
        begin = F.struct(F.lit("0" * 128).alias("n"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"))

        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.get(codes, F.greatest(i - window, F.lit(0)))
            was = F.when(i >= window, count(acc["n"], leaves)).otherwise(F.lit(0))
            left = let(was, lambda k: F.struct(F.when(k > 0, put(acc["n"], leaves, k - 1)).otherwise(acc["n"]).alias("n"), (acc["sum"] - F.get(gain, k)).alias("sum")))
            came = let(left, lambda t: let(count(t["n"], enters) + 1, lambda k: F.struct(put(t["n"], enters, k).alias("n"), (t["sum"] + F.get(gain, k)).alias("sum"))))
            return let(came, lambda t: F.struct(t["n"].alias("n"), t["sum"].alias("sum"), F.when((i >= window - 1) & (t["sum"] < acc["least"]), t["sum"]).otherwise(acc["least"]).alias("least")))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), begin, step, lambda acc: F.lit(math.log2(window)) - acc["least"] / window)

    return let(F.transform(F.split(candidate, ""), lambda c: F.ascii(c)), fold)


def _kind(found: Column, order: int, keep=None) -> Column:
    kept = F.filter(found, keep) if keep else found
    return F.transform(kept, lambda x: F.struct(x["at"].alias("at"), F.lit(order).alias("kind"), x["to"].alias("to")))


def entropic(text: Column, classes=CLASSES, window: int = WINDOW, allowed: str = ALLOWED) -> Column:
    """Spans (at, kind, to) of candidates with a high-entropy window that the allow-list doesn't name. Texts without a run of
    `window` characters of any class, which are most, are searched once."""
    def high(least: float) -> Callable[[Column], Column]:
        return lambda x: ~x["match"].rlike(allowed) & (best_entropy(x["match"], window) >= least)

    parts = [_kind(located(text, pattern), 3, high(least)) for _, pattern, least in classes]
    found = F.array_distinct(F.concat(*parts))
    return F.when(text.rlike(f"[A-Za-z0-9+/_=-]{{{window}}}"), found).otherwise(F.array().cast("array<struct<at:int,kind:int,to:int>>"))


def with_spans(documents: DataFrame) -> DataFrame:
    """documents with __base and __spans: arrays of (at, kind, to), by place and kind. Entropy adds only what no base span
    overlaps. A null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    base = F.array_sort(F.concat(_kind(located(text, ASSIGN, 2), 0, lambda x: F.length(x["part"]) >= 6), _kind(located(text, ACCESS), 1), _kind(located(text, HEX), 2)))
    own = [F.col(f"`{c}`") for c in documents.columns if c not in ("__base", "__spans")]
    first = documents.select(*own, base.alias("__base"), entropic(text).alias("__more"))
    more = F.filter("__more", lambda e: ~F.exists("__base", lambda b: (b["at"] < e["to"]) & (e["at"] < b["to"])))
    return first.select(*own, "__base", F.array_sort(F.concat("__base", more)).alias("__spans"))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["at"].cast("string"), x["to"].cast("string"))), ",")


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per row of documents, in one narrow stage.

    Null and empty texts have no spans and the hash of an empty string. Repeated rows are scanned each, other columns are
    ignored, and an empty table gives no rows. Spans that begin at one place are ordered by kind. Whole texts are searched,
    in time near their length."""
    count = lambda k: F.size(F.filter("__base", lambda x: x["kind"] == k)).cast("bigint")
    return with_spans(documents.select("doc_id", "text")).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans_text(F.col("__base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("__spans")).alias("spans"))


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """documents with every span replaced by the mark, overlapping ones by a single mark, and n_chars made to fit. Texts
    without spans, null ones too, stay as they are; so do all other columns, whatever their names."""

    def rebuilt(text: Column, spans: Column) -> Column:
        """Up to each span comes the text since the furthest end before it and a mark, unless an earlier span covers it."""

        def pieces(ends: Column) -> Column:
            own = F.transform(spans, lambda x, i: F.when(x["at"] >= F.get(ends, i), F.concat(F.substring(text, F.get(ends, i) + 1, x["at"] - F.get(ends, i)), F.lit(mark))).otherwise(F.lit("")))
            return F.concat(F.array_join(own, ""), F.substring(text, F.array_max(F.transform(spans, lambda x: x["to"])) + 1, F.length(text)))

        return let(F.transform(spans, lambda x: x["to"]), lambda to: let(prefix(to, lambda a, b: F.greatest(a, b), F.lit(0)), pieces))

    # the rows as one struct, so that no column's name can meet ours
    held = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    found = with_spans(held)
    text = F.when(F.size("__spans") > 0, rebuilt(F.col("text"), F.col("__spans"))).otherwise(F.col("text"))
    made = found.select("row", "__spans", text.alias("new"))
    n = F.when(F.size("__spans") > 0, F.length("new").cast("bigint")).otherwise(F.col("row.n_chars")) if "n_chars" in documents.columns else None
    return made.select(*[F.col("new").alias("text") if c == "text" else n.alias("n_chars") if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in documents.columns])
