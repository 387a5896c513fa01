"""Typed read of one sheet: row 0 names the columns, each column gets a type.

A column is a whole number, a number, a date or a truth value when all of its
non-blank cells read as one; else it is text.  NaN reads as missing.  One
aggregation decides all columns; the header is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.numbers import NUMBER_PATTERN, strip

# In the order in which they are tried.
_KINDS = (("bigint", r"^[+-]?[0-9]{1,18}$"), ("double", NUMBER_PATTERN), ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), ("boolean", r"(?i)^(true|false)$"))


def typed_read(rows: DataFrame) -> DataFrame:
    """``(row_idx, values)`` of one file -> ``row_idx`` and typed columns."""
    first = rows.filter("row_idx = 0").select("values").first()
    names: list[str] = []
    for i, raw in enumerate(first["values"] if first else []):
        base = (raw or "").strip() or f"column_{i + 1}"
        name, k = base, 1
        while name.lower() in {n.lower() for n in [*names, "row_idx"]}:
            k += 1
            name = f"{base}_{k}"
        names.append(name)
    cells = rows.filter("row_idx > 0").select("row_idx", *[_cell(i).alias(f"c{i}") for i in range(len(names))])
    checks = [
        F.bool_and(F.col(f"c{i}").isNull() | (F.col(f"c{i}").rlike(pattern) & F.col(f"c{i}").try_cast(kind).isNotNull())).alias(f"k{i}_{kind}")
        for i in range(len(names)) for kind, pattern in _KINDS
    ]
    known = cells.agg(*checks, *[F.count(f"c{i}").alias(f"n{i}") for i in range(len(names))]).first() if names else None

    def kind_of(i: int) -> str:
        if not known[f"n{i}"]:
            return "string"
        return next((kind for kind, _ in _KINDS if known[f"k{i}_{kind}"]), "string")

    return cells.select("row_idx", *[F.col(f"c{i}").try_cast(kind_of(i)).alias(n) for i, n in enumerate(names)])


def _cell(i: int):
    text = strip(F.try_element_at(F.col("values"), F.lit(i + 1)))
    return F.when((text != "") & (F.lower(text) != "nan"), text)
