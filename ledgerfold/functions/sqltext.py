"""SQL-text forms of the bulk column expressions.

Operators that build one expression per column (dozens of measure columns,
month patterns) use these strings with ``selectExpr`` / ``F.expr``: each column
is then one call into the JVM instead of dozens, which keeps plan building fast
for wide reports.  The semantics equal the Column forms in the sibling modules
(tests compare them).
"""

from __future__ import annotations

from ledgerfold.functions.numbers import NUMBER_PATTERN, SPACES


def q(name: str) -> str:
    """Quote a column name for Spark SQL."""
    return "`" + name.replace("`", "``") + "`"


def lit(s: str) -> str:
    """A Spark SQL string literal (backslashes and quotes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


NUM = lit(NUMBER_PATTERN)


def strip(expr: str) -> str:
    return f"btrim({expr}, {lit(SPACES)})"


def guarded_double(expr: str) -> str:
    t = strip(expr)
    return f"(CASE WHEN {t} RLIKE {NUM} THEN try_cast({t} AS DOUBLE) END)"


def accounting_number(expr: str, replace_all: bool = True) -> str:
    """Accounting text -> double (see ``numbers.accounting_number``).

    The regex rewrite of ``(x)`` runs only when the text holds a ``(``, and
    ``$``/``,`` are removed with ``translate`` (a character map, no regex); the
    only regex on every value is the number guard."""
    if replace_all:
        rew = f"regexp_replace({expr}, {lit(r'\((.*)\)')}, '-$1')"
    else:
        rew = f"regexp_replace({expr}, {lit(r'(?s)^(.*?)\(((?-s:.*))\)')}, '$1-$2')"
    neg = f"(CASE WHEN instr({expr}, '(') > 0 THEN {rew} ELSE {expr} END)"
    stripped = f"translate({neg}, '$,', '')"
    return f"coalesce({guarded_double(stripped)}, 0D)"


def measure_to_double(name: str, is_string: bool) -> str:
    if is_string:
        return accounting_number(q(name))
    return f"coalesce(CAST({q(name)} AS DOUBLE), 0D)"


# ------------------------------------------------------------------ periods (staged)

from ledgerfold.spec import MONTH_NAMES  # noqa: E402

SHORT_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _period(y: str, m: str) -> str:
    return (f"(CASE WHEN ({y}) IS NOT NULL AND ({m}) IS NOT NULL THEN "
            f"named_struct('year', CAST({y} AS INT), 'month', CAST({m} AS INT)) END)")


def _int_of(part: str) -> str:
    return f"try_cast(nullif({part}, '') AS INT)"


def _pivot(y: str) -> str:
    return f"(CASE WHEN {y} < 50 THEN {y} + 2000 WHEN {y} < 100 THEN {y} + 1900 ELSE {y} END)"


def filename_parts(base: str) -> list[tuple[str, str]]:
    """Year-text extracts of the file-name forms.  Each month pattern runs only
    when the lower-cased name contains that month's name (a plain substring
    test, far cheaper than the regex; the result is the same)."""
    out = []
    low = f"lower({base})"
    for i, m in enumerate(MONTH_NAMES, start=1):
        rx = f"regexp_extract({base}, {lit(rf'(?i)(?:^|[\s_\-]){m.lower()}\s*(\d{{4}}|\d{{2}})\b')}, 1)"
        out.append((f"m{i}", f"(CASE WHEN contains({low}, {lit(m.lower())}) THEN {rx} ELSE '' END)"))
    short_pat = r"(?i)\b(" + "|".join(SHORT_MONTHS) + r")\s*[.\s-]*(\d{4}|\d{2})\b"
    out.append(("sname", f"lower(regexp_extract({base}, {lit(short_pat)}, 1))"))
    out.append(("syear", f"regexp_extract({base}, {lit(short_pat)}, 2)"))
    ym = r"(20\d{2})[-_](\d{1,2})\b"
    out.append(("ymy", f"regexp_extract({base}, {lit(ym)}, 1)"))
    out.append(("ymm", f"regexp_extract({base}, {lit(ym)}, 2)"))
    return out


def filename_period(get) -> str:
    cands = [_period(_pivot(_int_of(get(f"m{i}"))), str(i)) for i in range(1, 13)]
    arr = "array(" + ", ".join(lit(s) for s in SHORT_MONTHS) + ")"
    sm = f"nullif(array_position({arr}, {get('sname')}), 0)"
    cands.append(_period(_pivot(_int_of(get("syear"))), sm))
    y, m = _int_of(get("ymy")), _int_of(get("ymm"))
    cands.append(_period(y, f"(CASE WHEN {m} BETWEEN 1 AND 12 THEN {m} END)"))
    return "coalesce(" + ", ".join(cands) + ")"


def title_parts(s: str) -> list[tuple[str, str]]:
    out = [(f"m{i}", f"regexp_extract({s}, {lit(rf'(?i)^{m.lower()}\s+(\d{{4}})$')}, 1)")
           for i, m in enumerate(MONTH_NAMES, start=1)]
    ym = r"(20\d{2})[-/](\d{1,2})"
    out.append(("ymy", f"regexp_extract({s}, {lit(ym)}, 1)"))
    out.append(("ymm", f"regexp_extract({s}, {lit(ym)}, 2)"))
    return out


def title_period(get) -> str:
    cands = [_period(_int_of(get(f"m{i}")), str(i)) for i in range(1, 13)]
    y, m = _int_of(get("ymy")), _int_of(get("ymm"))
    cands.append(_period(y, f"(CASE WHEN {m} BETWEEN 1 AND 12 THEN {m} END)"))
    return "coalesce(" + ", ".join(cands) + ")"


def month_number_normalized(s: str) -> str:
    branches = " ".join(
        f"WHEN startswith({lit(m.lower())}, {s}) OR startswith({s}, {lit(m.lower())}) OR {s} = '{i}' THEN {i}"
        for i, m in enumerate(MONTH_NAMES, start=1)
    )
    num = f"(CASE WHEN {s} RLIKE {NUM} THEN try_cast({s} AS DOUBLE) END)"
    fallback = f"coalesce(CASE WHEN abs({num}) < 2147483648 THEN CAST({num} AS INT) END, 0)"
    return f"(CASE WHEN {s} IS NULL OR {s} = '' THEN CAST(NULL AS INT) {branches} ELSE {fallback} END)"


def format_period(p: str) -> str:
    """``November 2025``; month outside 1-12 -> ``2025-13``; null -> null."""
    names = "array(" + ", ".join(lit(m) for m in MONTH_NAMES) + ")"
    y, m = f"CAST({p}.year AS STRING)", f"{p}.month"
    return (f"(CASE WHEN {p} IS NULL THEN CAST(NULL AS STRING) WHEN {m} BETWEEN 1 AND 12 "
            f"THEN concat_ws(' ', element_at({names}, {m}), {y}) ELSE concat({y}, '-', CAST({m} AS STRING)) END)")


def discrepancy_notes(t: str, f: str, h: str) -> str:
    """Notes when the file-name or title period disagrees with the table period."""
    ts, fs, hs = format_period(t), format_period(f), format_period(h)
    n1 = f"CASE WHEN {f} IS NOT NULL AND NOT ({f} <=> {t}) THEN concat('Filename suggests ', {fs}, '; table period is ', {ts}, '.') END"
    n2 = f"CASE WHEN {h} IS NOT NULL AND NOT ({h} <=> {t}) THEN concat('Header suggests ', {hs}, '; table period is ', {ts}, '.') END"
    n3 = (f"CASE WHEN {f} IS NOT NULL AND {h} IS NOT NULL AND NOT ({f} <=> {h}) "
          f"THEN concat('Filename suggests ', {fs}, '; header suggests ', {hs}, '.') END")
    return f"(CASE WHEN {t} IS NULL THEN CAST(array() AS ARRAY<STRING>) ELSE array_compact(array({n1}, {n2}, {n3})) END)"
