"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .host_rules import LEAST_WEIGHT, MOST_FAILURES, MOST_WEIGHT, TAIL
from .url_filter import RULES, SOFT, SOFT_HITS, STRICT


def _url_sql() -> str:
    found = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INT"
    fits = lambda host, path: f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in longest)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest)
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH p AS (SELECT page_id, coalesce({lower('url')}, '') AS u,
    {lower("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT *, {' + '.join(map(found, STRICT))} AS n_strict, {' + '.join(map(found, SOFT))} AS n_soft FROM p)
SELECT page_id, host, path, CASE {rule} END AS rule,
    CASE {verdict} WHEN n_strict > 0 OR n_soft >= {SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft FROM h
"""


_HOST_SQL = rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
k AS (SELECT *, row_number() OVER () AS row_no, [ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] for i in range(1, len(ws) - 1)] AS wins FROM w),
e AS (SELECT row_no, unnest(wins) AS win, generate_subscripts(wins, 1) AS i FROM k),
d AS (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, win) AS n FROM e),
c AS (SELECT row_no, count(DISTINCT i + x) AS n_repeat_words FROM d, (VALUES (0), (1), (2)) v(x) WHERE n >= 2 GROUP BY row_no),
m AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM k LEFT JOIN c USING (row_no)),
f AS (SELECT *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines] AS fails FROM m),
g AS (SELECT source, r, count(*) AS n, sum(fails[r]::INT) AS n_failed FROM f, range(1, 5) t(r) GROUP BY ALL),
q AS (SELECT r, greatest(least(avg(n_failed / n), 1 - 1e-4), 1e-4) AS mu, var_pop(n_failed / n) AS v FROM g WHERE n >= 2 GROUP BY r),
p AS (SELECT r, coalesce(mu, 0.5) AS mu, CASE WHEN mu IS NULL THEN 2 WHEN v = 0 THEN {MOST_WEIGHT} ELSE least(greatest(mu * (1 - mu) / v - 1, {LEAST_WEIGHT}), {MOST_WEIGHT}) END AS weight
    FROM range(1, 5) t(r) LEFT JOIN q USING (r)),
s AS (SELECT source, r, n, mu, weight, (n_failed + mu * weight) / (n + weight) AS rate FROM g JOIN p USING (r)),
d2 AS (SELECT *, sqrt(rate * (1 - rate) / (n + weight + 1)) AS deviation FROM s),
v AS (SELECT source, list(rate - deviation > mu ORDER BY r) AS suspect, bool_or(rate - {TAIL} * deviation > {MOST_FAILURES}) AS bad FROM d2 GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fails[1] OR fails[2] AS base_failed,
    NOT (fails[1] OR fails[2] OR bad OR (fails[3] AND suspect[3]) OR (fails[4] AND suspect[4])) AS kept, bad AS host_bad,
    array_to_string([['short', 'repeated', 'symbols', 'lines'][i] for i in range(1, 5) if suspect[i]], ',') AS suspect
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

SQL = {"op5_host_rules": _HOST_SQL, "op7_url_vocabulary": _url_sql()}
