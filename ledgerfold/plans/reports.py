"""End-to-end report ingestion for many files at once.

``ingest(rows, spec)`` runs the whole path of one report family over a rows
table of many files (from :mod:`ledgerfold.sources.workbook` or derived from
tables) and returns three DataFrames:

* ``data``: one row per (file, key) -- the consolidated report;
* ``metadata``: one row per file -- periods from the table, the file name and
  the title block, discrepancy notes, report type, header issues;
* ``status``: one row per file -- ok / error with the reason.

Plan shape: the table search reads windows of rows from the top, only as far as a
file needs, and shuffles header-like cells; the rest of the header work (header row, mapping, gates) touches the rows
down to the header, and one assignment per distinct list of headers.  The data
rows are promoted by index (no pivot), filled (one shuffle on file blocks) and
grouped (one shuffle on keys).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions import sqltext as S
from ledgerfold.functions.periods import with_filename_period
from ledgerfold.operators import consolidate as cons
from ledgerfold.operators import headers as H
from ledgerfold.operators import periods as OP
from ledgerfold.plans.publish import Publication
from ledgerfold.session import materialize, release
from ledgerfold.sources import tables
from ledgerfold.sources.files import NOT_READ
from ledgerfold.spec import ReportSpec


@dataclass
class Ingested:
    data: DataFrame
    status: DataFrame
    rows: DataFrame  # promoted, cleaned rows before grouping (for charts and checks)
    describe: Callable[[], DataFrame]
    staged: list[str] = field(default_factory=list)

    @cached_property
    def metadata(self) -> DataFrame:
        """One row per sound file; planned when first asked for."""
        return self.describe()

    def close(self) -> None:
        """Delete the staged tables; the DataFrames can't be read afterwards."""
        release(self.data.sparkSession, self.staged)

    def write(self, path: str) -> int:
        """Publish the envelope's tables under ``path``: seen together or not at all; files
        that were there before are replaced, others stay (:mod:`ledgerfold.plans.publish`).
        Returns the version."""
        tables = {name: getattr(self, name) for name in ("data", "metadata", "status")}
        return Publication(self.status.sparkSession, path).publish(tables, self.status)


def _basename(path_col: str):
    return F.regexp_extract(F.col(path_col), r"([^/\\]*)$", 1)


def ingest(rows: DataFrame, spec: ReportSpec, filenames: DataFrame | None = None, strategy: str = "best",
           block_rows: int = 1 << 16, stage_rows: bool = False, files: DataFrame | None = None) -> Ingested:
    """Rows table ``(file, row_idx, values[, error])`` -> consolidated data, metadata, status.

    Every file of ``rows``, and of ``files`` (a listing) when given, gets one
    status row.  A file with an error row keeps that error and gives no data.
    ``filenames`` maps ``file`` to the uploaded name used for the period hint;
    by default the base name of ``file``.  ``stage_rows`` writes the rows table
    first (worth it when it comes from decoding files, which the later branches
    would otherwise repeat).  ``Ingested.close()`` deletes what was staged."""
    staged: list[str] = []
    rows = rows.select("file", "row_idx", "values", (F.col("error") if "error" in rows.columns else F.lit(None).cast("string")).alias("error"))
    if stage_rows:
        rows = materialize(rows, staged)
    listed = rows.groupBy("file").agg(F.max("error").alias("error"))
    if files is not None:
        listed = listed.unionByName(files.select("file").distinct().join(listed, "file", "left_anti").withColumn("error", F.lit(NOT_READ)))
    # The header side is small: the starts (a row per file) and the mapping (a row
    # per column per file).  Both feed several branches; staged, they are computed
    # once and keep the Python matching out of every later branch.
    broken = listed.filter(F.col("error").isNotNull())
    sound = listed.filter(F.col("error").isNull()).select("file")
    rows = rows.filter((F.col("row_idx") >= 0) & F.col("error").isNull()).drop("error").join(broken.select("file"), "file", "left_anti")
    starts = tables.table_start(rows, spec, sound, staged)
    top = tables.top_cells(rows, starts)
    header_raw = tables.header_from(top, starts)
    headers = H.prepare_headers(header_raw, spec)
    mapping = H.resolve_mapping(headers, spec.canonical, strategy)
    if spec.blank_header_as:
        mapping = _blank_header_fallback(header_raw, mapping, spec.blank_header_as)
    mapping = materialize(mapping, staged)

    files = starts.select("file")
    validation = H.validate_files(mapping.select("file", "canonical"), spec, files)
    good = validation.filter("ok").select("file")

    groups = {}
    if spec.month_columns:
        groups["__month"] = spec.month_columns
    if spec.year_columns:
        groups["__year"] = spec.year_columns
    good_starts = starts.join(good, "file", "left_semi")
    wide = tables.promote(rows, good_starts, mapping, spec.canonical, groups, spec.column_names)

    prepared = cons.prepare_rows(wide, spec, "file", "row_idx", block_rows)
    data = cons.group_rows(prepared, spec, "file", "row_idx", per_file=True, sort=False)
    present = mapping.groupBy("file").agg(F.collect_set("canonical").alias("__present"))
    data = _null_absent(data, present, spec)

    def describe() -> DataFrame:
        return _metadata(wide, top, starts, header_raw, mapping, present, good, filenames, spec, block_rows)

    missed = F.when(~F.col("found"), F.lit(f"No table starts in the first {spec.scan_rows} rows.")) if spec.scan_rows else F.lit(None).cast("string")
    status = validation.join(starts, "file").select(
        "file", F.when(F.col("ok"), F.lit("ok")).otherwise(F.lit("error")).alias("status"),
        F.when(~F.col("ok"), F.coalesce(missed, F.col("error"))).alias("error"),
    ).unionByName(broken.select("file", F.lit("error").alias("status"), "error"))
    return Ingested(data=data, status=status, rows=prepared, describe=describe, staged=staged)


def _metadata(wide: DataFrame, top: DataFrame, starts: DataFrame, header_raw: DataFrame, mapping: DataFrame, present: DataFrame,
              good: DataFrame, filenames: DataFrame | None, spec: ReportSpec, block_rows: int) -> DataFrame:
    """Periods, notes, type and header issues of every sound file."""
    # Table period and row count: one narrow pass over the filled keys.
    if spec.period_from == "month_year" and "__month" in wide.columns:
        narrow = wide.select("file", "row_idx", *spec.fill_keys, *[k for k in spec.keys if k not in spec.fill_keys and k in wide.columns], "__month", "__year")
        narrow = cons.keep_rows(narrow, spec, "file", "row_idx", block_rows)
        per_file = OP.period_and_rows(narrow, OP.month_year_period(narrow, "__month", "__year"))
    else:
        narrow = wide.select("file", "row_idx", *[k for k in spec.keys if k in wide.columns], "__year")
        per_file = OP.period_and_rows(cons.keep_rows(narrow, spec, "file", "row_idx", block_rows))
        per_file = per_file.drop("canonical_period").join(OP.period_from_year(wide, "__year"), "file", "left")
    files = starts.select("file")
    title_p = OP.period_from_title(tables.title_cells_from(top, starts))
    names = filenames if filenames is not None else files.select("file", _basename("file").alias("filename"))
    name_p = with_filename_period(names, "filename", "period_from_filename").select("file", "filename", "period_from_filename")

    ftype = H.detect_type(mapping.select("file", "canonical"), per_file)

    meta = (
        files.join(name_p, "file", "left")
        .join(title_p, "file", "left")
        .join(ftype, "file", "left")
        .join(present, "file", "left")
    )
    cols = [
        "file", "filename",
        f"{S.format_period('canonical_period')} AS canonical_period",
        f"{S.format_period('period_from_filename')} AS period_from_filename",
        f"{S.format_period('period_from_header')} AS period_from_header",
        f"{S.discrepancy_notes('canonical_period', 'period_from_filename', 'period_from_header')} AS discrepancy_notes",
        "coalesce(file_type, 'combined') AS file_type",
        "CASE WHEN filename IS NOT NULL THEN array(filename) ELSE CAST(array() AS ARRAY<STRING>) END AS filenames",
    ]
    if spec.drop_nuisance_headers:
        issues = H.header_issues(header_raw)
        meta = meta.join(H.issues_per_file(issues).select("file", "header_issues"), "file", "left")
        cols.append("coalesce(header_issues, CAST(array() AS ARRAY<STRING>)) AS header_issues")
    return meta.selectExpr(*cols).join(good, "file", "left_semi")


def _null_absent(data: DataFrame, present: DataFrame, spec: ReportSpec) -> DataFrame:
    """Measures a file does not have are null for that file (not 0).  All files
    share one wide schema; ``present`` is one small row per file."""
    inverse = {v: k for k, v in spec.column_names.items()}
    canon = {c: inverse.get(c) for c in data.columns}
    measures = [c for c in data.columns if canon[c] and (canon[c] in spec.sums or canon[c] in spec.firsts)]
    j = data.join(present, "file", "left")
    return j.selectExpr(
        *[
            f"CASE WHEN array_contains(__present, {S.lit(canon[c])}) THEN {S.q(c)} END AS {S.q(c)}" if c in measures else S.q(c)
            for c in data.columns
        ]
    )


def _blank_header_fallback(header_raw: DataFrame, mapping: DataFrame, target: str) -> DataFrame:
    """Stated intent of the reference (R14): in files where ``target`` is not
    mapped, the first blank header column takes that name."""
    from ledgerfold.functions.text import clean_header

    blanks = (
        header_raw.filter(clean_header("header") == "")
        .groupBy("file").agg(F.min("col_idx").alias("col_idx"))
    )
    has = mapping.filter(F.col("canonical") == target).select("file")
    extra = blanks.join(has, "file", "left_anti").select(
        "file", F.col("col_idx").cast("int"), F.lit("").alias("header"), F.lit(target).alias("canonical")
    )
    return mapping.unionByName(extra)
