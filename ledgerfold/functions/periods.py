"""Reporting periods as native column expressions (regexp_extract, no UDF).

A period is ``struct<year:int, month:int>``; null when absent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerfold.functions.numbers import strip

from ledgerfold.spec import MONTH_NAMES

# Three-letter month forms accepted in file names.
SHORT_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def period(year: Column, month: Column) -> Column:
    return F.when(
        year.isNotNull() & month.isNotNull(),
        F.struct(year.cast("int").alias("year"), month.cast("int").alias("month")),
    )


def _extract_int(s: Column, pattern: str, group: int) -> Column:
    # regexp_extract gives '' (not null) on no match; nullif before the cast.
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit("")).try_cast("int")


def _pivot_two_digit(y: Column) -> Column:
    return F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)


def strip_extension(name) -> Column:
    """Drop the last ``.ext``; names without a dot are kept."""
    return F.regexp_replace(_col(name), r"\.[^.]*$", "")


def _filename_candidates(base: Column) -> list[tuple[str, Column]]:
    """Year-text extracts of the file-name forms, in priority order."""
    out = []
    for i, m in enumerate(MONTH_NAMES, start=1):
        out.append((f"m{i}", F.regexp_extract(base, rf"(?i)(?:^|[\s_\-]){m.lower()}\s*(\d{{4}}|\d{{2}})\b", 1)))
    short_pat = r"(?i)\b(" + "|".join(SHORT_MONTHS) + r")\s*[.\s-]*(\d{4}|\d{2})\b"
    out.append(("sname", F.lower(F.regexp_extract(base, short_pat, 1))))
    out.append(("syear", F.regexp_extract(base, short_pat, 2)))
    ym_pat = r"(20\d{2})[-_](\d{1,2})\b"
    out.append(("ymy", F.regexp_extract(base, ym_pat, 1)))
    out.append(("ymm", F.regexp_extract(base, ym_pat, 2)))
    return out


def _filename_period_from_parts(get) -> Column:
    """Combine the extracts (``get(name)`` gives each as a column) into a period."""
    cands = []
    for i in range(1, 13):
        y = F.nullif(get(f"m{i}"), F.lit("")).try_cast("int")
        cands.append(period(_pivot_two_digit(y), F.lit(i)))
    short_month = F.array_position(F.array(*[F.lit(s) for s in SHORT_MONTHS]), get("sname"))
    short_year = _pivot_two_digit(F.nullif(get("syear"), F.lit("")).try_cast("int"))
    cands.append(period(short_year, F.when(short_month > 0, short_month)))
    y = F.nullif(get("ymy"), F.lit("")).try_cast("int")
    m = F.nullif(get("ymm"), F.lit("")).try_cast("int")
    cands.append(period(y, F.when((m >= 1) & (m <= 12), m)))
    return F.coalesce(*cands)


def period_from_filename(name) -> Column:
    """Period named in a file name: full month + year (calendar order), then a
    three-letter month + year, then ``20YY-MM`` / ``20YY_MM``; first hit wins.

    As one expression this is large; on big inputs prefer
    :func:`with_filename_period`, which stages it in three projections."""
    base = strip_extension(name)
    parts = dict(_filename_candidates(base))
    return F.when(_col(name).isNotNull() & (_col(name) != ""), _filename_period_from_parts(parts.__getitem__))


def with_filename_period(df, name_col: str, out_col: str):
    """``df`` plus ``out_col``: the file-name period, computed in stages so each
    generated method stays small (the single expression repeats the extension
    strip in every candidate).  Built from SQL text: a few JVM calls in all."""
    from ledgerfold.functions import sqltext as S

    d = df.withColumn("__fnp_base", strip_extension(name_col))
    parts = S.filename_parts("__fnp_base")
    d = d.selectExpr("*", *[f"{e} AS __fnp_{n}" for n, e in parts])
    name = S.q(name_col)
    res = f"CASE WHEN {name} IS NOT NULL AND {name} <> '' THEN {S.filename_period(lambda n: '__fnp_' + n)} END"
    d = d.selectExpr("*", f"{res} AS {S.q(out_col)}")
    return d.drop("__fnp_base", *[f"__fnp_{n}" for n, _ in parts])


def _title_candidates(s: Column) -> list[tuple[str, Column]]:
    out = []
    for i, m in enumerate(MONTH_NAMES, start=1):
        out.append((f"m{i}", F.regexp_extract(s, rf"(?i)^{m.lower()}\s+(\d{{4}})$", 1)))
    ym_pat = r"(20\d{2})[-/](\d{1,2})"
    out.append(("ymy", F.regexp_extract(s, ym_pat, 1)))
    out.append(("ymm", F.regexp_extract(s, ym_pat, 2)))
    return out


def _title_period_from_parts(get) -> Column:
    cands = []
    for i in range(1, 13):
        cands.append(period(F.nullif(get(f"m{i}"), F.lit("")).try_cast("int"), F.lit(i)))
    y = F.nullif(get("ymy"), F.lit("")).try_cast("int")
    m = F.nullif(get("ymm"), F.lit("")).try_cast("int")
    cands.append(period(y, F.when((m >= 1) & (m <= 12), m)))
    return F.coalesce(*cands)


def period_from_title_text(value) -> Column:
    """Period in one title cell: ``^Month YYYY$`` (any case), else ``20YY-MM`` or
    ``20YY/MM`` anywhere with month 1-12.  See :func:`with_title_period` for the
    staged form used on large inputs."""
    parts = dict(_title_candidates(strip(_col(value))))
    return _title_period_from_parts(parts.__getitem__)


def with_title_period(df, value_col: str, out_col: str):
    """``df`` plus ``out_col``: the title-cell period, computed in stages."""
    from ledgerfold.functions import sqltext as S

    d = df.withColumn("__tp_s", strip(F.col(value_col)))
    parts = S.title_parts("__tp_s")
    d = d.selectExpr("*", *[f"{e} AS __tp_{n}" for n, e in parts])
    d = d.selectExpr("*", f"{S.title_period(lambda n: '__tp_' + n)} AS {S.q(out_col)}")
    return d.drop("__tp_s", *[f"__tp_{n}" for n, _ in parts])


def _month_number_normalized(s: Column) -> Column:
    branches = None
    for i, m in enumerate(MONTH_NAMES, start=1):
        lm = F.lit(m.lower())
        cond = F.startswith(lm, s) | F.startswith(s, lm) | (s == F.lit(str(i)))
        branches = F.when(cond, F.lit(i)) if branches is None else branches.when(cond, F.lit(i))
    as_num = F.when(
        s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
        s.try_cast("double"),
    )
    fallback = F.coalesce(F.when(F.abs(as_num) < 2147483648, as_num.cast("int")), F.lit(0))
    return F.when(s.isNull() | (s == ""), F.lit(None).cast("int")).otherwise(branches.otherwise(fallback))


def month_number(text) -> Column:
    """Month text -> 1..12 by prefix either way or the number text; else int(float);
    else 0.  Empty text is treated as missing (null), not January."""
    return _month_number_normalized(F.lower(strip(_col(text))))


def with_month_number(df, text_col: str, out_col: str):
    """``df`` plus ``out_col`` = month_number(text_col), normalising the text once."""
    from ledgerfold.functions import sqltext as S

    d = df.withColumn("__mn_s", F.lower(strip(F.col(text_col))))
    return d.selectExpr("*", f"{S.month_number_normalized('__mn_s')} AS {S.q(out_col)}").drop("__mn_s")


def year_number(value, is_numeric: bool = False) -> Column:
    """Year cell -> int: numbers are truncated; text must be an integer ("2025.0" fails)."""
    v = _col(value)
    if is_numeric:
        d = v.cast("double")
        return F.when(~F.isnan(d) & (F.abs(d) < 2147483648), d.cast("int"))
    t = strip(v.cast("string"))
    return F.when(t.rlike(r"^[+-]?[0-9]{1,9}$"), t.try_cast("int"))


def format_period(p) -> Column:
    """``November 2025``; a month outside 1-12 gives ``2025-13``."""
    p = _col(p)
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    y = p.getField("year").cast("string")
    m = p.getField("month")
    return F.when(p.isNull(), F.lit(None).cast("string")).when(
        (m >= 1) & (m <= 12), F.concat_ws(" ", F.element_at(names, m), y)
    ).otherwise(F.concat(y, F.lit("-"), m.cast("string")))


def discrepancy_notes(table_p, file_p, title_p) -> Column:
    """Up to three notes when the file-name or title period disagrees with the
    table period (the table is authoritative); empty when the table has none."""
    t, f, h = _col(table_p), _col(file_p), _col(title_p)
    ts, fs, hs = format_period(t), format_period(f), format_period(h)
    notes = F.array(
        F.when(f.isNotNull() & ~f.eqNullSafe(t),
               F.concat(F.lit("Filename suggests "), fs, F.lit("; table period is "), ts, F.lit("."))),
        F.when(h.isNotNull() & ~h.eqNullSafe(t),
               F.concat(F.lit("Header suggests "), hs, F.lit("; table period is "), ts, F.lit("."))),
        F.when(f.isNotNull() & h.isNotNull() & ~f.eqNullSafe(h),
               F.concat(F.lit("Filename suggests "), fs, F.lit("; header suggests "), hs, F.lit("."))),
    )
    return F.when(t.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(notes))
