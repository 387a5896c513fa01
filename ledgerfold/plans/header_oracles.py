"""SQL for the header-matching queries.

DuckDB has no Ratcliff/Obershelp ratio, so the SQL carries a table of ratios that
the standard library works out for every header text the queries can derive;
normalising, key-token rules, thresholds and order are SQL.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from ledgerfold.operators.headers import CAPTIVE_TOKENS, CLIENT_TOKENS, EXACT_RATIO, NAME_TOKENS, TOKEN_RATIO
from ledgerfold.spec import CAPTIVE_SPEC, KEY_RULES

WIDTH = 31


def _plain(text: str) -> str:
    return " ".join(re.sub(r"[^a-z0-9\s]", "", text.lower()).split())


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _headers_sql() -> str:
    names = "[" + ", ".join(map(_quoted, CAPTIVE_SPEC.canonical)) + "]"
    n = len(CAPTIVE_SPEC.canonical)
    return f"""named AS (SELECT p_partkey AS k, {names}[p_partkey % {n} + 1] AS name, p_partkey // {n} % 5 AS kind, p_partkey % 7 + 2 AS pos FROM part),
h AS (SELECT CAST(k // {WIDTH} AS VARCHAR) AS file, CAST(k % {WIDTH} AS INTEGER) AS col_idx, name,
  CASE kind WHEN 0 THEN name WHEN 1 THEN lower(name) || ' #' WHEN 2 THEN substr(name, 1, pos - 1) || substr(name, pos + 1)
    WHEN 3 THEN upper(name) || ' ↑' ELSE '  ' || name END AS header FROM named)"""


def _ratios_sql() -> str:
    texts = {_plain(n) for n in CAPTIVE_SPEC.canonical}
    texts |= {_plain(n[:p - 1] + n[p:]) for n in CAPTIVE_SPEC.canonical for p in range(2, 9)}
    rows = []
    for i, c in enumerate(CAPTIVE_SPEC.canonical):
        rule = _quoted(KEY_RULES[c]) if c in KEY_RULES else "NULL"
        rows += [f"({i}, {_quoted(c)}, {rule}, {_quoted(t)}, {SequenceMatcher(None, _plain(c), t).ratio()!r}e0, {str(_plain(c) == t).lower()})" for t in sorted(texts)]
    return "ratios AS (SELECT * FROM (VALUES " + ",\n".join(rows) + ") AS r(canon_pos, canonical, rule, n_act, ratio, exact))"


def _any(tokens) -> str:
    return "(" + " OR ".join(f"contains(n_act, '{t}')" for t in tokens) + ")"


def sql() -> dict[str, str]:
    norm = "trim(regexp_replace(regexp_replace(lower(trim(header)), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
    pairs = f"""WITH {_headers_sql()},
d AS (SELECT header, {norm} AS n_act FROM (SELECT DISTINCT header FROM h)),
{_ratios_sql()},
pairs AS (SELECT d.header, r.* FROM d JOIN ratios r USING (n_act)),
matched AS (SELECT * FROM pairs WHERE header <> '' AND n_act <> '' AND (exact OR ratio >= {EXACT_RATIO} OR (ratio >= {TOKEN_RATIO} AND CASE rule
  WHEN 'captive' THEN {_any(CAPTIVE_TOKENS)} AND {_any(NAME_TOKENS)} WHEN 'client' THEN {_any(CLIENT_TOKENS)} ELSE false END)))"""
    # The derived headers are made from the names, one of each in a file, so the
    # mapping that is meant is known; of equal texts in a file the first counts.
    meant = f"""WITH {_headers_sql()}, c AS (SELECT file, col_idx, trim(replace(header, '↑', '')) AS header, name AS canonical FROM h)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY file, header ORDER BY col_idx) = 1"""
    # Name by name in list order: the first matching column that is still free.
    first = pairs.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
c AS (SELECT file, col_idx, trim(replace(header, '↑', '')) AS header FROM h QUALIFY row_number() OVER (PARTITION BY file, trim(replace(header, '↑', '')) ORDER BY col_idx) = 1),
m AS (SELECT DISTINCT trim(replace(header, '↑', '')) AS header, canonical, canon_pos FROM matched),
free AS (SELECT file, canon_pos, list(col_idx ORDER BY col_idx) AS cols FROM c JOIN m USING (header) GROUP BY ALL),
walk AS (
  SELECT DISTINCT file, 0 AS i, []::INTEGER[] AS picked FROM c
  UNION ALL
  SELECT w.file, w.i + 1, list_append(w.picked, list_filter(f.cols, lambda x: NOT list_contains(w.picked, x))[1])
  FROM walk w LEFT JOIN free f ON f.file = w.file AND f.canon_pos = w.i WHERE w.i < {len(CAPTIVE_SPEC.canonical)}),
pick AS (SELECT file, unnest(picked) AS col_idx, generate_subscripts(picked, 1) - 1 AS canon_pos FROM walk WHERE i = {len(CAPTIVE_SPEC.canonical)})
SELECT file, col_idx, c.header, m.canonical FROM pick JOIN c USING (file, col_idx) JOIN m ON m.header = c.header AND m.canon_pos = pick.canon_pos"""
    return {
        "header_mapping_first": first,
        "header_similarity": pairs + " SELECT header, canonical, exact, ratio FROM pairs",
        "header_match": pairs + " SELECT header, canonical, ratio FROM matched",
        "header_mapping": meant,
    }
