"""Consolidation: fill keys, drop summary rows, parse measures, group by key.

One operator serves all three report families; the spec carries the column
lists.  ``first`` columns take the value of the first row in file order, nulls
included, via ``min_by(value, row_idx)`` (``first()`` is not deterministic after a
shuffle).  Sums and ``min_by`` both aggregate partially before the shuffle, so a
hot key costs one row per map task on the wire, not one row per input row.
Rows that were filled are grouped within their block first (``group_blocks``):
most files lie in one block, and their wide rows are shuffled once in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.operators.clean import (
    BLOCK,
    DEFAULT_BLOCK_ROWS,
    SPREAD,
    clean_measures,
    drop_summary_rows,
    fill_blocks,
    forward_fill,
)
from ledgerfold.functions import sqltext as S
from ledgerfold.spec import ReportSpec


def ensure_keys(df: DataFrame, spec: ReportSpec) -> DataFrame:
    """Optional keys that are absent become constant ''."""
    for k in spec.optional_keys:
        if k not in df.columns:
            df = df.withColumn(k, F.lit(""))
    missing = [k for k in spec.keys if k not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}. Found: {df.columns}")
    return df


def keep_rows(df: DataFrame, spec: ReportSpec, file_col: str | None = "file", order_col: str = "row_idx",
              block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Fill the keys and drop summary rows; measures stay as they are."""
    df = ensure_keys(df, spec)
    fill = [k for k in spec.fill_keys if k in df.columns]
    df = forward_fill(df, fill, partition_col=file_col, order_col=order_col, block_rows=block_rows)
    return drop_summary_rows(df, spec.keys[0], spec.markers, spec.marker_mode)


def prepare_rows(
    df: DataFrame,
    spec: ReportSpec,
    file_col: str | None = "file",
    order_col: str = "row_idx",
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """Fill -> drop summary rows -> clean measures: the row-level half of the
    consolidation (the fill runs before the filter, so blanks under a summary row
    inherit the marker and go with it).

    The measure parse is row-local and independent of both, so it runs first,
    before the fill's shuffle: the rows then travel with doubles instead of
    text."""
    return keep_rows(clean_measures(ensure_keys(df, spec), spec), spec, file_col, order_col, block_rows)


def group_rows(
    df: DataFrame,
    spec: ReportSpec,
    file_col: str | None = "file",
    order_col: str = "row_idx",
    per_file: bool | None = None,
    sort: bool = True,
) -> DataFrame:
    """Group cleaned rows by key: sum the additive measures, first-in-file-order
    for the rest; output keys, sums (spec order), firsts."""
    per_file = spec.per_file if per_file is None else per_file
    group_cols = _group_cols(spec, file_col, per_file)
    order_sql = S.q(order_col) if not (file_col and not per_file) else f"struct({S.q(file_col)}, {S.q(order_col)})"
    grouped = df.groupBy(*group_cols).agg(*_measures(df, spec, order_sql))
    return _arranged(grouped, spec, group_cols, sort)


def _group_cols(spec: ReportSpec, file_col: str | None, per_file: bool) -> list[str]:
    return ([file_col] if (per_file and file_col) else []) + list(spec.keys)


def _measures(df: DataFrame, spec: ReportSpec, order_sql: str) -> list[Column]:
    names = spec.column_names
    cols = set(df.columns)
    sums = [names.get(c, c) for c in spec.sums if names.get(c, c) in cols and c not in spec.firsts]
    firsts = [names.get(c, c) for c in spec.firsts if names.get(c, c) in cols]
    return [
        *[F.expr(f"sum({S.q(c)})").alias(c) for c in sums],
        *[F.expr(f"min_by({S.q(c)}, {order_sql})").alias(c) for c in firsts],
    ]


def _arranged(grouped: DataFrame, spec: ReportSpec, group_cols: list[str], sort: bool) -> DataFrame:
    if spec.output_order:
        ordered = [c for c in spec.output_order if c in grouped.columns]
        rest = [c for c in grouped.columns if c not in ordered]
        extra = [c for c in rest if c not in group_cols]
        grouped = grouped.select(*[c for c in group_cols if c not in ordered], *ordered, *extra)
    if sort:
        grouped = grouped.orderBy(*group_cols)
    return grouped


def group_blocks(df: DataFrame, spec: ReportSpec, file_col: str, order_col: str, sort: bool) -> DataFrame:
    """``group_rows`` per file for rows of ``fill_blocks``: rows are grouped within
    their block, where they lie.  That is all for a file of one block; only the
    groups of files with several are shuffled once more and put together."""
    group_cols = _group_cols(spec, file_col, True)
    first, spread = "__first", "__spread"
    # As an aggregate the mark stays above the fill's shuffle, so that both branches read the same one.
    here = df.groupBy(*group_cols, BLOCK).agg(
        *_measures(df, spec, S.q(order_col)), F.min(order_col).alias(first), F.max(F.coalesce(F.col(SPREAD), F.lit(True))).alias(spread),
    )
    names = [c for c in here.columns if c not in (BLOCK, first, spread)]
    parts = here.where(F.col(spread))
    grouped = here.where(~F.col(spread)).select(*names).unionByName(parts.groupBy(*group_cols).agg(*_measures(parts, spec, first)))
    return _arranged(grouped, spec, group_cols, sort)


def consolidate(
    df: DataFrame,
    spec: ReportSpec,
    file_col: str | None = "file",
    order_col: str = "row_idx",
    per_file: bool | None = None,
    sort: bool = False,
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """Rows with canonical column names (plus ``file`` and ``row_idx``) -> one
    row per key (per file unless ``per_file=False``).  The input is read twice, as in ``forward_fill``."""
    fill = [k for k in spec.fill_keys if k in df.columns]
    if file_col and fill and (spec.per_file if per_file is None else per_file):
        rows = fill_blocks(clean_measures(ensure_keys(df, spec), spec), fill, file_col, order_col, block_rows)
        return group_blocks(drop_summary_rows(rows, spec.keys[0], spec.markers, spec.marker_mode), spec, file_col, order_col, sort)
    rows = prepare_rows(df, spec, file_col, order_col, block_rows)
    return group_rows(rows, spec, file_col, order_col, per_file, sort)


def first_in_group(df: DataFrame, keys, value: str, order_col: str, skip_nulls: bool = False) -> DataFrame:
    """First value per group in row order.  ``skip_nulls=False`` keeps a null first
    value (table consolidation); ``True`` takes the first non-null (charts)."""
    src = df.filter(F.col(value).isNotNull()) if skip_nulls else df
    return src.groupBy(*keys).agg(F.min_by(F.col(value), F.col(order_col)).alias(value))
