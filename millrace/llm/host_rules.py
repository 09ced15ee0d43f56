"""Quality rules with host-level verdicts.

Each document is measured against four rules. For each rule, failures are added up by host (here: the column that names
where a document came from), and each host's failure rate is shrunk towards the rate of all hosts by a beta prior that is
fitted to the hosts themselves. A host's verdict follows from its posterior: it is suspect in a rule if its rate lies above
the prior's mean by a posterior standard deviation or more, and bad if its rate lies above MOST_FAILURES by TAIL of them.
Joined back, a bad host drops all its documents, and a suspect one those that fail the rule it is suspect in; where the host
is not suspect, one failure of a soft rule is forgiven.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, scratch, window_hashes, words

#: The rules: name and condition over the measures. The first two are the base rules, which drop a document by themselves.
RULES = (
    ("short", "n_words < 50"),
    ("repeated", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("lines", "10 * n_dup_lines > 3 * n_lines"),
)
BASE = 2
#: A host is bad if its shrunk rate less TAIL posterior deviations is over MOST_FAILURES; suspect if it is, less one, over
#: the prior's mean.
MOST_FAILURES, TAIL = 0.5, 2.0
#: Bounds of a prior's weight, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0


def repeated_words(ws: Column) -> Column:
    """How many words lie in a 3-word window that is found twice or more; ws must be a column or a lambda's variable."""

    def covered(at: Column) -> Column:  # ascending window positions; each adds the words that the next doesn't
        return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), F.lit(0), lambda acc, i: acc + F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - F.get(at, i), F.lit(3))))

    def positions(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(ranked, lambda r: F.array_sort(F.transform(F.filter(r, lambda x, j: (F.coalesce(F.get(r, j - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(r, j + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"])))

    return let(window_hashes(ws, 3), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(positions(h), covered)))


def measures(documents: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, n_lines and the base measures of each row; a null text has no words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("bigint").alias("n_words"), F.length(F.array_join(ws, "")).cast("bigint").alias("word_chars"), repeated_words(ws).cast("bigint").alias("n_repeat_words"))

    def of_lines(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("bigint").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"))

    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols")
    return documents.select("doc_id", F.col(host).alias("host"), let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l"), symbols).select("doc_id", "host", "w.*", "l.*", "n_symbols")


def beta_prior(mean: float | None, variance: float | None) -> tuple[float, float]:
    """Beta parameters by moments; the weight is held within its bounds. Where hosts don't differ it is the greatest, so that
    small hosts follow the mean; without hosts the prior is even."""
    if mean is None:
        return 1.0, 1.0
    mean = min(max(mean, 1e-4), 1 - 1e-4)
    weight = MOST_WEIGHT if not variance else min(max(mean * (1 - mean) / variance - 1, LEAST_WEIGHT), MOST_WEIGHT)
    return mean * weight, (1 - mean) * weight


def host_verdicts(failures: DataFrame, rules: list[str]) -> DataFrame:
    """host, n_docs and, for each rule, failed_<rule>, rate_<rule> (shrunk) and suspect_<rule>; bad: whether a rate is over
    MOST_FAILURES. From (host, fails_<rule>...). Priors are fitted over hosts of two documents or more."""
    hosts = failures.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(f"fails_{r}").cast("bigint")).alias(f"failed_{r}") for r in rules])
    shares = [F.col(f"failed_{r}") / F.col("n_docs") for r in rules]
    fitted = hosts.filter(F.col("n_docs") >= 2).agg(*[f(x) for x in shares for f in (F.avg, F.var_pop)]).first()
    out, bad = [], []
    for k, r in enumerate(rules):
        a, b = beta_prior(fitted[2 * k], fitted[2 * k + 1])
        rate = (F.col(f"failed_{r}") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b))
        deviation = F.sqrt(rate * (1 - rate) / (F.col("n_docs") + F.lit(a + b + 1)))
        out += [rate.alias(f"rate_{r}"), (rate - deviation > a / (a + b)).alias(f"suspect_{r}")]
        bad.append(rate - TAIL * deviation > MOST_FAILURES)
    return hosts.select("*", *out, reduce(Column.__or__, bad).alias("bad"))


def host_rules(documents: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the measures, base_failed, kept, host_bad and suspect (the rules that the host is suspect in, comma-joined):
    one row per row of documents.

    base_failed: under 50 words, or over half of the words lie in repeated 3-word windows. kept: not base_failed, the host is
    not bad, and no rule fails that the host is suspect in. Null hosts are one host; a null text is empty. An empty table
    gives no rows; other columns are ignored, and repeated rows are judged each. The join with the hosts has no hint: the
    planner broadcasts their table if its measured size allows."""
    names = [name for name, _ in RULES]
    with scratch(documents.sparkSession) as cut:
        base = cut(measures(documents, host).select("*", *[F.expr(rule).alias(f"fails_{name}") for name, rule in RULES]), "measures")
        known = cut(host_verdicts(base, names).withColumnRenamed("host", "h"), "hosts")
        joined = base.join(known, F.col("host").eqNullSafe(F.col("h")), "left")
        failed = reduce(Column.__or__, [F.col(f"fails_{n}") for n in names[:BASE]])
        blamed = reduce(Column.__or__, [F.col(f"fails_{n}") & F.col(f"suspect_{n}") for n in names])
        suspect = F.concat_ws(",", *[F.when(F.col(f"suspect_{n}"), F.lit(n)) for n in names])
        judged = joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.col("bad") & ~blamed).alias("kept"), F.col("bad").alias("host_bad"), suspect.alias("suspect"))
        return materialize(judged, "judged")
