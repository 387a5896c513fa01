"""Explore view over a result table: search, facets, sort, page, profiles.

The reference does this in the browser on one thread; here each step is a
DataFrame expression.  Search and facets are filters (pushed to the scan where
possible), sorting is a distributed range sort, and ranks and deep pages come from
the sorted partitions' sizes (:mod:`ledgerfold.operators.ranks`): no task ever
holds the rows before a page.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ledgerfold.functions.numbers import guarded_double, js_text, strip
from ledgerfold.operators.ranks import Ranked

PAGE_SIZES = (10, 25, 50, 100)
DEFAULT_PAGE_SIZE = 25


def cell_text(df: DataFrame, col: str) -> Column:
    """A cell as the browser prints it; null -> ''."""
    kind = dict(df.dtypes)[col]
    if kind in ("double", "float"):
        t = js_text(F.col(col))
    elif kind.startswith("decimal") or kind in ("int", "bigint", "smallint", "tinyint"):
        t = js_text(F.col(col).cast("double"))
    else:
        t = F.col(col).cast("string")
    return F.coalesce(t, F.lit(""))


def search_rows(df: DataFrame, term: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows where the trimmed, lower-cased term is a substring of any listed
    column's text; an empty term keeps every row."""
    term = (term or "").strip().lower()
    columns = list(columns or df.columns)
    if not term or not columns:
        return df
    pred = reduce(lambda a, b: a | b, [F.lower(cell_text(df, c)).contains(term) for c in columns])
    return df.filter(pred)


def facet_filter(df: DataFrame, selections: Mapping[str, Sequence[str]]) -> DataFrame:
    """For each column with a non-empty selection, keep rows whose text is one of
    the (trimmed) choices; facets AND together, values OR."""
    for col, values in selections.items():
        vals = [str(v).strip() for v in values]
        if vals:
            df = df.filter(cell_text(df, col).isin(*vals))
    return df


def is_number_type(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, NumericType)


def is_numeric_column(df: DataFrame, col: str) -> Column:
    """Aggregate: every non-empty value of a text column parses as a number (empty
    column -> true); of other types only the numeric ones are numeric."""
    if dict(df.dtypes)[col] != "string":
        return F.lit(is_number_type(df, col))
    v = F.col(col)
    bad = v.isNotNull() & (v != "") & guarded_double(v).isNull()
    return F.coalesce(F.bool_and(~bad), F.lit(True))


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: ``(column_name, is_numeric)``, from one aggregate pass."""
    columns = list(columns or df.columns)
    one = df.agg(*[is_numeric_column(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    return one.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("is_numeric")) for i, c in enumerate(columns)]))
    )


def sort_values(df: DataFrame, column: str, direction: str = "asc", numeric: bool | None = None) -> list[tuple[Column, bool]]:
    """(key, descending) of the user sort, without nulls.  Numeric: numbers (null
    as 0), NaN/unparseable last in both directions.  Text: case- and
    accent-insensitive, null as ''.  ``numeric=None`` profiles the column."""
    desc = direction == "desc"
    kind = dict(df.dtypes)[column]
    if numeric is None:
        numeric = bool(df.agg(is_numeric_column(df, column)).first()[0])
    if numeric and (kind == "string" or is_number_type(df, column)):
        if kind == "string":
            v = F.when(strip(column) == "", F.lit(0.0)).otherwise(guarded_double(column))
            v = F.when(F.col(column).isNull(), F.lit(0.0)).otherwise(F.coalesce(v, F.lit(float("nan"))))
        else:
            v = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
        return [(F.isnan(v), False), (v, desc)]
    return [(F.collate(F.coalesce(F.col(column).cast("string"), F.lit("")), "UNICODE_CI_AI"), desc)]


def sort_keys(df: DataFrame, column: str, direction: str = "asc", numeric: bool = True,
              order_col: str | None = None) -> list[Column]:
    """Order for the user sort (:func:`sort_values`).  Ties keep the original
    order (``order_col``)."""
    keys = [v.desc() if desc else v.asc() for v, desc in sort_values(df, column, direction, numeric)]
    if order_col:
        keys.append(F.col(order_col).asc())
    return keys


def user_sort(df: DataFrame, column: str | None, direction: str = "asc", numeric: bool | None = None,
              order_col: str | None = None) -> DataFrame:
    """asc / desc / none (original order).  ``numeric=None`` profiles the column."""
    if not column or direction not in ("asc", "desc"):
        return df.orderBy(order_col) if order_col else df
    if numeric is None:
        numeric = bool(df.agg(is_numeric_column(df, column)).first()[0])
    return df.orderBy(*sort_keys(df, column, direction, numeric, order_col))


def page_bounds(total_rows: int, page_index: int, page_size: int) -> tuple[int, int]:
    """(clamped page index, offset) for a page request."""
    pages = 0 if page_size <= 0 else -(-total_rows // page_size)
    idx = min(max(0, page_index), max(0, pages - 1))
    return idx, idx * page_size


def sort_rank(df: DataFrame, column: str, direction: str = "asc", numeric: bool | None = None, order_col: str | None = None,
              name: str = "rank") -> DataFrame:
    """``df`` with each row's place in the user sort; ``order_col`` must tell
    rows apart."""
    if numeric is None:
        numeric = bool(df.agg(is_numeric_column(df, column)).first()[0])
    return Ranked(df, sort_keys(df, column, direction, numeric, order_col)).with_rank(name)


def page_slice(df: DataFrame, keys: Sequence[Column], page_index: int, page_size: int = DEFAULT_PAGE_SIZE,
               current_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One page of ``df`` in the order of ``keys``, which must tell rows apart.  A
    size outside the allowed list keeps the current size; the index is clamped
    to the last page.  The first page is a top-k of one page; deeper ones come
    from :class:`Ranked`, which never gathers the rows before them."""
    size = page_size if page_size in PAGE_SIZES else current_size
    if page_index <= 0:
        return df.orderBy(*keys).limit(size)
    ranked = Ranked(df, keys)
    return ranked.slice(page_bounds(ranked.total, page_index, size)[1], size)


def page_info(df: DataFrame, page_index: int, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One row: total rows, page count, clamped page index, 1-based range."""
    n = F.count(F.lit(1))
    one = df.agg(n.alias("total_rows"))
    pages = F.when(F.lit(page_size) <= 0, F.lit(0)).otherwise(F.ceil(F.col("total_rows") / F.lit(page_size))).cast("bigint")
    idx = F.least(F.greatest(F.lit(0), F.lit(page_index)), F.greatest(F.lit(0), F.col("page_count") - 1)).cast("bigint")
    return (
        one.select("total_rows", pages.alias("page_count"))
        .select("total_rows", "page_count", idx.alias("page_index"))
        .select(
            "total_rows", "page_count", "page_index",
            F.when(F.col("total_rows") == 0, F.lit(0)).otherwise(F.col("page_index") * page_size + 1).cast("bigint").alias("range_start"),
            F.least(F.col("page_index") * page_size + page_size, F.col("total_rows")).cast("bigint").alias("range_end"),
        )
    )


def distinct_values(df: DataFrame, col: str, search: str | None = None) -> DataFrame:
    """Distinct trimmed values (null and '' skipped), case-insensitive order;
    optionally only those containing the lower-cased search term."""
    v = F.col(col).cast("string")
    out = df.filter(v.isNotNull() & (v != "")).select(strip(v).alias("value")).distinct()
    term = (search or "").strip().lower()
    if term:
        out = out.filter(F.lower("value").contains(term))
    return out.orderBy(F.collate(F.col("value"), "UNICODE_CI_AI"), "value")


def explore(df: DataFrame, search: str = "", columns: Sequence[str] | None = None,
            facets: Mapping[str, Sequence[str]] | None = None, sort_column: str | None = None,
            direction: str = "asc", numeric: bool | None = None, order_col: str | None = None,
            page_index: int = 0, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Search -> facets -> sort -> page, in this order."""
    rows = search_rows(df, search, columns)
    rows = facet_filter(rows, facets or {})
    if sort_column and direction in ("asc", "desc"):
        if numeric is None:
            numeric = bool(df.agg(is_numeric_column(df, sort_column)).first()[0])
        return page_slice(rows, sort_keys(df, sort_column, direction, numeric, order_col), page_index, page_size)
    keys = [F.col(order_col)] if order_col else [F.monotonically_increasing_id()]
    return page_slice(rows, keys, page_index, page_size)
