"""The chart reports over consolidated data; measures are found by their
canonical name or an alias of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.operators import summaries
from ledgerfold.spec import CAPTIVE_CLIENT, CAPTIVE_KEY, COMMISSION_COMMISSION, COMMISSION_PNL

RENT, UNITS, FEE_RLIP, FEE_RAP = "Additional Rent", "Total Available Units", "POPIC Fee RLIP", "POPIC Fee RAP"


def measure(data: DataFrame, canonical: str) -> str:
    """The column that holds a measure; an error names a missing one."""
    col = summaries.resolve_column(data.columns, canonical)
    if col is None:
        raise ValueError(f"Missing required column: {canonical}")
    return col


def _ordered(data: DataFrame) -> DataFrame:
    """Consolidated rows in report order: by file and keys."""
    lead = [c for c in ("file", "pair") if c in data.columns]
    return data.withColumn("__ord", F.struct(*lead, CAPTIVE_KEY, CAPTIVE_CLIENT))


def _top(canonical: str, n: int, take_first: bool) -> Callable[[DataFrame], DataFrame]:
    def run(data: DataFrame) -> DataFrame:
        return summaries.top_entities(_ordered(data), measure(data, canonical), n, CAPTIVE_KEY, CAPTIVE_CLIENT, "__ord", take_first)

    return run


def _pie(canonical: str) -> Callable[[DataFrame], DataFrame]:
    def run(data: DataFrame) -> DataFrame:
        return summaries.top_n_others(_ordered(data), measure(data, canonical), 4, CAPTIVE_KEY, CAPTIVE_CLIENT, "__ord")

    return run


CHARTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "top_rent": _top(RENT, 7, False),
    "top_units": _top(UNITS, 5, True),
    "fee_rlip": _pie(FEE_RLIP),
    "fee_rap": _pie(FEE_RAP),
    "fee_share": lambda d: summaries.share_of_two(d, measure(d, FEE_RLIP), measure(d, FEE_RAP), FEE_RLIP, FEE_RAP),
    "monthly_commission": lambda d: summaries.monthly_totals(d, COMMISSION_COMMISSION),
    "monthly_pnl": lambda d: summaries.monthly_totals(d, COMMISSION_PNL),
}
