"""Find the table under a title block, and promote its header row.

All steps work on the rows table ``(file, row_idx, values)`` of many files:

* ``table_start``: the first row whose cells match the family's header rule; 0
  when none.  A frontier search: windows of rows that widen downwards, each read
  only for the files that are still open (nothing found, and rows left), so a table
  at the top costs one small window however deep the file is, and all rows are
  searched where none turns up (the spec may name a limit).  Cells that can't match
  are dropped where they are read, the rest is matched once per text.
* ``title_cells``: non-blank cells above the table start (period hints).
* ``header_table``: the header row as ``(file, col_idx, header)``.
* ``promote``: data rows below the header, with one column per canonical
  name, read by index from the row array -- no pivot, no shuffle of cells.
  The per-file column positions are one small row per file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions import sqltext as S
from ledgerfold.functions.numbers import strip
from ledgerfold.operators.headers import match_pairs, may_match_any
from ledgerfold.session import materialize, release
from ledgerfold.sources.workbook import rows_to_cells
from ledgerfold.spec import (
    CAPTIVE_KEY,
    CAPTIVE_NAME,
    CLIENT_NAME,
    SALESPERSON,
    VENDOR,
    ReportSpec,
)

# Which canonical names each family's start rule looks for.
START_NAMES = {
    "captive": (CAPTIVE_KEY,),
    "commission": (CAPTIVE_NAME, SALESPERSON, CLIENT_NAME),
    "referral": (VENDOR, CAPTIVE_NAME, CLIENT_NAME),
}


def _row_flags(cells: DataFrame, spec: ReportSpec) -> DataFrame:
    """Which start names each row holds.  Cells that can't match any are dropped
    first, JVM-side, so what is shuffled are header-like cells only."""
    names = START_NAMES[spec.start_rule]
    texts = cells.filter(F.col("value").isNotNull()).withColumn("header", strip("value")).filter(may_match_any("header", names))
    hits = match_pairs(texts.select("header"), names).filter("matched").select("header", "canonical")
    return texts.join(hits, "header").groupBy("file", "row_idx").agg(
        *[F.bool_or(F.col("canonical") == n).alias(f"h{i}") for i, n in enumerate(names)]
    )


def top_rows(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows of each file down to its table start, with ``start``.  The lowest start (one
    number) limits what is read of a written rows table."""
    lowest = starts.agg(F.max("start")).first()[0]
    near = rows.filter(F.col("row_idx") <= (lowest if lowest is not None else -1))
    return near.join(starts.select("file", "start"), "file").filter(F.col("row_idx") <= F.col("start"))


def top_cells(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Cells of each file down to its table start: all that the header side
    needs.  ``starts`` has one row for each file."""
    return rows_to_cells(top_rows(rows, starts).select("file", "row_idx", "values"))


def _first_match(cells: DataFrame, spec: ReportSpec) -> DataFrame:
    """``(file, start)``: the first row of each file that meets the start rule."""
    flags = _row_flags(cells, spec)
    if spec.start_rule == "captive":
        ok = F.col("h0")
    elif spec.start_rule == "commission":  # captive AND (salesperson OR client)
        ok = F.col("h0") & (F.col("h1") | F.col("h2"))
    else:  # (vendor AND (captive OR client)) OR (captive AND client)
        ok = (F.col("h0") & (F.col("h1") | F.col("h2"))) | (F.col("h1") & F.col("h2"))
    return flags.filter(ok).groupBy("file").agg(F.min("row_idx").alias("start"))


#: Rows of the first window, and how much lower each further one ends.
FIRST_WINDOW, WIDEN = 256, 8


def table_start(rows: DataFrame, spec: ReportSpec, files: DataFrame | None = None, staged: list[str] | None = None) -> DataFrame:
    """``(file, start, found)`` for every file in ``rows`` (or listed in ``files``),
    as a written table; ``staged`` collects its folder.

    One round a window.  A round's finds are written; the next one reads the rows of
    the files left that reach below the window, which a written rows table finds by
    its row groups.  Windows widen ``WIDEN`` times, so a file of n rows is
    open for log(n) rounds at most and each of its rows is searched once."""
    spark = rows.sparkSession
    files = files if files is not None else rows.select("file").distinct()
    kept: list[str] = []
    low, high, limit = 0, FIRST_WINDOW, spec.scan_rows
    left, found = materialize(files.select("file"), kept), None
    while True:
        high = min(high, limit) if limit else high
        window = rows.filter((F.col("row_idx") >= low) & (F.col("row_idx") < high)).select("file", "row_idx", "values")
        if low:
            window = window.join(left, "file", "left_semi")
        hits = materialize(_first_match(rows_to_cells(window), spec), kept)
        found = hits if found is None else found.unionByName(hits)
        left = left.select("file").join(hits, "file", "left_anti")
        if (limit and high >= limit) or left.isEmpty():
            break
        if not low:  # once: how far down the files left go
            lower = rows.filter(F.col("row_idx") >= high).select("file", "row_idx").join(left, "file", "left_semi")
            depth = materialize(lower.groupBy("file").agg(F.max("row_idx").alias("last")), kept)
        low, high = high, high * WIDEN
        left = materialize(left.join(depth.filter(F.col("last") >= low), "file", "left_semi"), kept)
        if left.isEmpty():
            break
    out = materialize(files.select("file").join(found, "file", "left").select(
        "file", F.coalesce(F.col("start"), F.lit(0)).cast("long").alias("start"), F.col("start").isNotNull().alias("found")
    ), staged)
    release(spark, kept)
    return out


def title_cells_from(cells: DataFrame, starts: DataFrame) -> DataFrame:
    """Non-blank trimmed cells above the table start, from the top cells."""
    c = cells.join(starts, "file").filter(F.col("row_idx") < F.col("start"))
    return c.select("file", "row_idx", "col_idx", strip("value").alias("value")).filter(
        F.col("value").isNotNull() & (F.col("value") != "")
    )


def header_from(cells: DataFrame, starts: DataFrame) -> DataFrame:
    """The header row ``(file, col_idx, header)``, from the top cells."""
    c = cells.join(starts, "file").filter(F.col("row_idx") == F.col("start"))
    return c.select("file", "col_idx", F.col("value").alias("header"))


def title_cells(rows: DataFrame, starts: DataFrame, max_row: int | None = None) -> DataFrame:
    """Non-blank trimmed cells above the table start, ``(file, row_idx, col_idx, value)``.

    ``max_row`` (the spec's scan limit; every start lies below it) filters the
    rows before the join, so only the top of each file is joined (and, on a
    parquet source, read)."""
    if max_row is not None:
        rows = rows.filter(F.col("row_idx") < max_row)
    return title_cells_from(rows_to_cells(rows), starts)


def header_table(rows: DataFrame, starts: DataFrame, max_row: int | None = None) -> DataFrame:
    """The header row of each file as ``(file, col_idx, header)`` (``max_row`` as
    in :func:`title_cells`)."""
    if max_row is not None:
        rows = rows.filter(F.col("row_idx") < max_row)
    return header_from(rows_to_cells(rows), starts)


def _positions(mapping: DataFrame, canonical: Sequence[str], groups: dict[str, Sequence[str]]) -> DataFrame:
    """One row per file: the column index of each canonical name (null when not
    mapped), plus the first mapped member of each candidate group."""
    per = mapping.groupBy("file").agg(
        *[F.expr(f"min(CASE WHEN canonical = {S.lit(c)} THEN col_idx END)").alias(f"__i{i}") for i, c in enumerate(canonical)]
    )
    extra = []
    for gname, members in groups.items():
        idx = [f"__i{list(canonical).index(m)}" for m in members if m in canonical]
        extra.append(F.coalesce(*[F.col(c) for c in idx]).alias(f"__g_{gname}") if idx else F.lit(None).cast("int").alias(f"__g_{gname}"))
    return per.select("*", *extra)


def promote(rows: DataFrame, starts: DataFrame, mapping: DataFrame, canonical: Sequence[str],
            groups: dict[str, Sequence[str]] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Data rows (below the header) with canonical columns ``file, row_idx, <canonical...>``.

    Only files listed in ``starts`` are read; a canonical name not mapped in a
    file is null there.  ``names`` renames canonical names to column names.
    The per-file table (start + column positions) is one row per file, joined
    once to the rows."""
    groups = groups or {}
    names = names or {}
    pos = starts.join(_positions(mapping, canonical, groups), "file", "left")
    j = rows.join(pos, "file").filter(F.col("row_idx") > F.col("start"))
    cols = ["file", "row_idx"]
    for i, c in enumerate(canonical):
        cols.append(f"try_element_at(`values`, __i{i} + 1) AS {S.q(names.get(c, c))}")
    for gname in groups:
        cols.append(f"try_element_at(`values`, __g_{gname} + 1) AS {S.q(gname)}")
    return j.selectExpr(*cols)
