"""Text column expressions: header cleaning, entity keys, display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerfold.functions.numbers import strip

# Placeholder header names treated as nuisance columns.
NUISANCE_HEADERS = ("unnamed", "column", "null", "none")
SORT_ARROW = "↑"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_header(h) -> Column:
    """Drop sort arrows and trim; null -> ''."""
    return F.coalesce(strip(F.regexp_replace(_col(h), SORT_ARROW, "")), F.lit(""))


def normalize_header(h) -> Column:
    """strip, lower, delete [^a-z0-9 whitespace], collapse whitespace, strip."""
    s = F.lower(strip(_col(h)))
    s = F.regexp_replace(s, r"(?U)[^a-z0-9\s]", "")
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    return F.coalesce(F.trim(s), F.lit(""))


def is_nuisance_header(h) -> Column:
    """Blank, a single letter, or a placeholder name (any case)."""
    s = strip(_col(h))
    return (
        s.isNull()
        | (s == "")
        | ((F.length(s) == 1) & s.rlike(r"^\p{L}$"))
        | F.lower(s).isin(*NUISANCE_HEADERS)
    )


def entity_key(captive, client=None) -> Column:
    """trim(captive), plus `` | `` + trim(client) when the client is non-empty."""
    cap = F.coalesce(strip(_col(captive).cast("string")), F.lit(""))
    if client is None:
        return cap
    cli = F.coalesce(strip(_col(client).cast("string")), F.lit(""))
    return F.when(cli != "", F.concat(cap, F.lit(" | "), cli)).otherwise(cap)


def truncate_middle(s, max_len: int, ellipsis: str = "…") -> Column:
    """Longer than ``max_len``: first h + ellipsis + last h, h = (max_len-3)//2."""
    c = _col(s)
    h = (max_len - 3) // 2
    tail = F.substring(c, -h, h) if h > 0 else F.lit("")
    return F.when(F.length(c) > max_len, F.concat(F.substring(c, 1, h), F.lit(ellipsis), tail)).otherwise(c)


def trim_zeros(s: Column) -> Column:
    """'1,234.50' -> '1,234.5'; '100.00' -> '100'."""
    return F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def number_display(x, decimals: int = 2) -> Column:
    """Thousands separators and at most ``decimals`` decimals (trailing zeros dropped); null -> ''."""
    c = _col(x)
    return F.when(c.isNull(), F.lit("")).otherwise(trim_zeros(F.format_number(F.round(c, decimals), decimals)))


def percent_display(x) -> Column:
    """x*100 with at most 2 decimals and a trailing %."""
    c = _col(x)
    return F.when(c.isNull(), F.lit("")).otherwise(
        F.concat(trim_zeros(F.format_number(F.round(c * 100, 2), 2)), F.lit("%"))
    )


def currency_display(x) -> Column:
    """``$1,234.50``."""
    return F.concat(F.lit("$"), F.format_number(_col(x), 2))
