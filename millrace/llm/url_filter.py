"""URL filters: host and path rules, and a weighted vocabulary found by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

# One strict term rejects; soft terms reject once SOFT_HITS different ones are found.
STRICT = ("adult", "casino", "escort", "gambling", "hentai", "porn", "poker", "viagra", "xxx")
SOFT = ("ads", "bets", "bonus", "cheap", "click", "coupon", "farm", "free", "loan", "pills", "promo", "sex", "slots", "spam", "track", "win")
SOFT_HITS = 2
#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end].translate(_LOWER), rest[end:]
    return host, rest[: min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))]


class Rules:
    """Rules by host, so that a url is held against those of its host's own suffixes only."""

    def __init__(self, rules=RULES):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def longest(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[int, str | None, str | None] = (-1, None, None)
        at = 0
        while host and at >= 0:
            for start, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start) and len(host) - at + len(start) > best[0]:
                    best = (len(host) - at + len(start), host[at:] + start, verdict)
            at = host.find(".", at) + 1 or -1
        return best[1:]


def automaton(strict=STRICT, soft=SOFT):
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, terms in ((1, strict), (0, soft)):
        for term in terms:
            found.add_word(term, (kind, term))
    found.make_automaton()
    return found


def hits(url: str | None, terms) -> tuple[int, int]:
    """Strict and soft terms found in a url, each term once; a term counts where no ASCII letter or digit touches it."""
    text = (url or "").translate(_LOWER)
    strict, soft = set(), set()
    if text:
        for end, (kind, term) in terms.iter(text):
            begin = end - len(term)
            if (begin < 0 or text[begin] not in _INSIDE) and (end + 1 == len(text) or text[end + 1] not in _INSIDE):
                (strict if kind else soft).add(term)
    return len(strict), len(soft)


def judge(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft: one row per row of pages, in one narrow stage.

    A fitting rule decides, the longest of several; else one strict term or soft_hits different soft terms in the whole
    url block it. A null or empty url has no parts and no terms, and is allowed. Rules of one length that both fit can't be, as
    each host has one suffix of a length. Repeated rows are judged each, whole urls count in one pass over them, and an empty
    table gives no rows. Only page_id and url are read, so that other columns may have any name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, terms = Rules(rules), automaton(strict, soft)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                rule, verdict = table.longest(host, path)
                n_strict, n_soft = hits(url, terms)
                verdict = verdict or ("block" if n_strict or n_soft >= soft_hits else "allow")
                for column, value in zip(out, (host, path, rule, verdict, n_strict, n_soft), strict=True):
                    column.append(value)
            kinds = (pa.string(),) * 4 + (pa.int32(),) * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    read = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    return read.mapInArrow(lambda b: tidy(run(b)), "page_id bigint, host string, path string, rule string, verdict string, n_strict int, n_soft int")
