"""Row cleaning: forward fill, summary-row filter, NaN to null, measure parsing.

Forward fill is order-dependent.  The plain form, a window partitioned by file,
puts a whole file on one task; a single file may hold a third of all rows, so the
fill here runs in two steps over fixed-size blocks of the row index:

1. fill inside each ``(file, block)`` with ``last(ignorenulls)``;
2. take the last non-null value of every block (a narrow aggregate, partial before its shuffle, one row per block), carry it forward
   across blocks with a window partitioned by file over that small table, and
   patch the rows still null at the head of each block by a join on ``(file, block)``.

The big side is shuffled once, on ``(file, block)``, and the join back reuses
that partitioning; the block table is small.  Nothing is cached.  Most files lie
in one block: ``fill_blocks`` says which, and those need no further shuffle to be
grouped by file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions import sqltext as S
from ledgerfold.functions.numbers import nan_to_null as _nan_to_null
from ledgerfold.spec import ReportSpec

DEFAULT_BLOCK_ROWS = 1 << 16
#: Columns of ``fill_blocks``: a row's block, and whether its partition has several.
BLOCK, SPREAD = "__ff_block", "__ff_spread"


def forward_fill(
    df: DataFrame,
    columns: Sequence[str],
    partition_col: str | None = "file",
    order_col: str = "row_idx",
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """Fill nulls with the last non-null value above, per ``partition_col`` in
    ``order_col`` order (an integral, unique row index).  Empty text is a value,
    not a gap.  Each column is filled on its own.

    The input is read twice: in full for the fill, and narrow (file, row index,
    filled columns) for the block tails; an input that is expensive to compute
    is best written to a table first."""
    if not columns:
        return df
    return fill_blocks(df, columns, partition_col, order_col, block_rows).select(*df.columns)


def fill_blocks(
    df: DataFrame,
    columns: Sequence[str],
    partition_col: str | None = "file",
    order_col: str = "row_idx",
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """``forward_fill`` with each row's ``BLOCK`` and ``SPREAD`` (null where the
    partition is).  The rows come out dealt by ``(partition_col, BLOCK)``."""
    columns = list(columns)
    part = [partition_col] if partition_col else []
    blk = BLOCK
    d = df.withColumn(blk, F.floor(F.col(order_col) / F.lit(block_rows)).cast("long"))
    w_local = (
        Window.partitionBy(*part, blk)
        .orderBy(order_col)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = d.select(
        *[c for c in d.columns if c not in columns],
        *[F.last(c, ignorenulls=True).over(w_local).alias(c) for c in columns],
    )
    # Straight from the input: only one row per task and block is shuffled.
    tails = d.groupBy(*part, blk).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order_col))).alias(f"__tail_{i}") for i, c in enumerate(columns)]
    )
    w_blocks = (
        Window.partitionBy(*part)
        .orderBy(blk)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = tails.select(
        *part,
        blk,
        (F.count("*").over(Window.partitionBy(*part)) > 1).alias(SPREAD),
        *[F.last(f"__tail_{i}", ignorenulls=True).over(w_blocks).alias(f"__carry_{i}") for i in range(len(columns))],
    )
    joined = local.join(carry, on=[*part, blk], how="left")
    out_cols = []
    for c in df.columns:
        if c in columns:
            i = columns.index(c)
            out_cols.append(F.coalesce(F.col(c), F.col(f"__carry_{i}")).alias(c))
        else:
            out_cols.append(F.col(c))
    return joined.select(*out_cols, blk, SPREAD)


def summary_row_filter(key: str, markers: Sequence[str], mode: str = "exact") -> Column:
    """Keep-row predicate: key non-null and not a summary marker.

    ``exact``: key equals a marker (case-sensitive, untrimmed);
    ``upper``: upper(key) is one of the markers."""
    k = F.col(key)
    if mode == "upper":
        return k.isNotNull() & ~F.upper(k).isin(*markers)
    return k.isNotNull() & ~k.isin(*markers)


def drop_summary_rows(df: DataFrame, key: str, markers: Sequence[str], mode: str = "exact") -> DataFrame:
    return df.filter(summary_row_filter(key, markers, mode))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> null over every float column (typed reads)."""
    kinds = dict(df.dtypes)
    return df.select(
        *[
            _nan_to_null(c).alias(c) if kinds[c] in ("double", "float") else F.col(c)
            for c in df.columns
        ]
    )


def clean_measures(df: DataFrame, spec: ReportSpec) -> DataFrame:
    """Keys to string, optional keys null -> '', measures to double (one projection)."""
    kinds = dict(df.dtypes)
    inverse = {v: k for k, v in spec.column_names.items()}
    exprs = []
    for c in df.columns:
        canon = inverse.get(c, c)
        if canon in spec.keys:
            e = f"CAST({S.q(c)} AS STRING)"
            if canon not in spec.fill_keys or canon in spec.optional_keys:
                e = f"coalesce({e}, '')"
            exprs.append(f"{e} AS {S.q(c)}")
        elif canon in spec.sums or (spec.parse_firsts and canon in spec.firsts):
            exprs.append(f"{S.measure_to_double(c, kinds[c] == 'string')} AS {S.q(c)}")
        else:
            exprs.append(S.q(c))
    # One SQL string per column: one JVM call each, however wide the report.
    return df.selectExpr(*exprs)
