"""Per-file reporting periods: from title cells, from the table, from the name.

Each is a ``groupBy(file)`` with ``min_by(period, position)``: partial
aggregation keeps one candidate per file per task, so a huge file never sits
on one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions import periods as P


def _first_period(df: DataFrame, file_col: str, period: Column, position: Column, name: str) -> DataFrame:
    # No filter on the period: a filter would be pushed below the projection and
    # inline the whole period expression a second time.  ``min_by`` skips rows
    # whose ordering value is null, which drops the rows without a period.
    return (
        df.select(F.col(file_col), period.alias("__p"), position.alias("__pos"))
        .groupBy(file_col)
        .agg(F.min_by("__p", F.when(F.col("__p").isNotNull(), F.col("__pos"))).alias(name))
        .filter(F.col(name).isNotNull())
    )


def period_from_title(cells: DataFrame, file_col: str = "file", row_col: str = "row_idx",
                      col_col: str = "col_idx", value_col: str = "value", name: str = "period_from_header") -> DataFrame:
    """First title cell (row-major) holding a period -> ``(file, period)``."""
    staged = P.with_title_period(cells.select(file_col, row_col, col_col, value_col), value_col, "__title_p")
    return _first_period(staged, file_col, F.col("__title_p"), F.struct(F.col(row_col), F.col(col_col)), name)


def month_year_period(df: DataFrame, month_col: str, year_col: str):
    """Text month and year columns -> the row's period, or null when invalid."""
    y = P.year_number(year_col, is_numeric=dict(df.dtypes)[year_col] != "string")
    m = P.month_number(month_col) if dict(df.dtypes)[month_col] == "string" else F.col(month_col).cast("int")
    return F.when(m.between(1, 12) & y.between(1900, 2100), P.period(y, m))


def period_and_rows(df: DataFrame, period=None, file_col: str = "file", order_col: str = "row_idx") -> DataFrame:
    """``(file, canonical_period, n_rows)``: the first row with a period, and the
    number of rows, in one aggregation."""
    p = F.lit(None).cast("struct<year:int,month:int>") if period is None else period
    staged = df.select(file_col, order_col, p.alias("__p"))
    return staged.groupBy(file_col).agg(
        F.min_by("__p", F.when(F.col("__p").isNotNull(), F.col(order_col))).alias("canonical_period"), F.count("*").alias("n_rows")
    )


def period_from_table(
    df: DataFrame,
    month_col: str,
    year_col: str,
    file_col: str = "file",
    order_col: str = "row_idx",
    name: str = "canonical_period",
) -> DataFrame:
    """First row with a valid month (1-12) and year (1900-2100) -> ``(file, period)``."""
    kinds = dict(df.dtypes)
    numeric = lambda c: kinds[c] not in ("string",)
    if not numeric(month_col):
        df = P.with_month_number(df, month_col, "__month_n")
        m = F.col("__month_n")
    else:
        m = F.col(month_col).cast("int")
    y = P.year_number(year_col, is_numeric=numeric(year_col))
    ok = m.between(1, 12) & y.between(1900, 2100)
    return _first_period(df, file_col, F.when(ok, P.period(y, m)), F.col(order_col), name)


def period_from_year(
    df: DataFrame,
    year_col: str = "Year",
    file_col: str = "file",
    order_col: str = "row_idx",
    name: str = "canonical_period",
) -> DataFrame:
    """First valid ``Year`` (1900-2100) -> ``(file, (year, 1))``."""
    kinds = dict(df.dtypes)
    y = P.year_number(year_col, is_numeric=kinds[year_col] != "string")
    return _first_period(df, file_col, F.when(y.between(1900, 2100), P.period(y, F.lit(1))), F.col(order_col), name)
