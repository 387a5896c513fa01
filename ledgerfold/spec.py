"""Report specifications: the three report families as data, not code.

A ``ReportSpec`` says which columns are keys, which are summed, which keep the
first value in file order, which keys are forward-filled, which rows are
summary rows, and how a file is recognised.  Every operator in the package reads
its column lists from a spec, so a new report family is a new spec value.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for right results.
# Canonical header names, month names and summary-row markers, in their
# natural order.
# ---------------------------------------------------------------------------

MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)

CAPTIVE_KEY = "Captive Name: Captive Name"
CAPTIVE_CLIENT = "Captive Name: Client"

CAPTIVE_TARGETS = (
    "Additional Rent", "Additional Rent Charge",
    "Retained At Property", "Retained at Property",
    "Gross Written Premium", "Taxes", "Credit Card Fees",
    "Administrative Fees", "Net Premium to Captive",
    "Claims Reserves", "Operating Expenses", "Proxy Tax",
    "Other Expenses", "Net Income", "Total Available Units",
    "Enrolled Units", "POPIC Fee RLIP FOF", "POPIC Fee RAP FOF",
    "POPIC Fee RLIP", "POPIC Fee RAP",
    "POPIC Fee From Parent RLIP", "POPIC Fee From Parent RAP",
    "Penetration %",
)
CAPTIVE_FIRSTS = ("Total Available Units",)
MONTH_COLUMN_CANDIDATES = ("Month", "Report Month", "Captive Name: Month")
YEAR_COLUMN_CANDIDATES = ("Year", "Report Year", "Captive Name: Year")

SALESPERSON = "Salesperson"
CAPTIVE_NAME = "Captive Name"
CLIENT_NAME = "Client Name (in POPIC)"
VENDOR = "Vendor"

COMMISSION_PNL = tuple(f"{m} P&L" for m in MONTH_NAMES)
COMMISSION_COMMISSION = tuple(f"{m} Commission" for m in MONTH_NAMES)
COMMISSION_SUMS = COMMISSION_PNL + COMMISSION_COMMISSION + ("Total",)
COMMISSION_FIRSTS = ("Year", "Income Type", "Commission Rate", "Account Name")
COMMISSION_OUTPUT_ORDER = (
    (SALESPERSON, CAPTIVE_NAME, CLIENT_NAME)
    + ("Income Type", "Commission Rate", "Account Name", "Year")
    + COMMISSION_COMMISSION + ("Total",) + COMMISSION_PNL
)

REFERRAL_MONTHS = MONTH_NAMES
REFERRAL_FEES = ("POPIC Fee",)
REFERRAL_PNL = tuple(f"P&L Name: {m}" for m in MONTH_NAMES)
REFERRAL_SUMS = REFERRAL_MONTHS + REFERRAL_FEES + REFERRAL_PNL
REFERRAL_FIRSTS = ("Year", "Referral Fee %")
REFERRAL_OUTPUT_ORDER = (
    (VENDOR, CAPTIVE_NAME, CLIENT_NAME)
    + ("Referral Fee %", "Year") + REFERRAL_FEES + REFERRAL_MONTHS + REFERRAL_PNL
)

# Summary-row markers: the captive family drops exactly "Subtotal"; the other
# two drop these three after upper-casing.
CAPTIVE_MARKERS = ("Subtotal",)
UPPER_MARKERS = ("SUBTOTAL", "COUNT", "TOTAL")

# Which key-token rule a canonical name matches by.
KEY_RULES = {
    CAPTIVE_KEY: "captive",
    CAPTIVE_CLIENT: "client",
    CAPTIVE_NAME: "captive",
    CLIENT_NAME: "client",
    SALESPERSON: "salesperson",
    VENDOR: "vendor",
}

# Rows scanned for the table header, for parity with the reference's limits
# (``spec.with_(scan_rows=...)``): captive 200, commission and referral 30.
CAPTIVE_SCAN_ROWS = 200
COMMISSION_SCAN_ROWS = 30
REFERRAL_SCAN_ROWS = 30

# Chart aliases: header -> canonical.
CHART_ALIASES = {
    "ADTL RENT": "Additional Rent",
    "Additional Rent Charge": "Additional Rent",
}


@dataclass(frozen=True)
class ReportSpec:
    """Declarative description of one report family."""

    name: str
    keys: tuple[str, ...]
    sums: tuple[str, ...]
    firsts: tuple[str, ...] = ()
    fill_keys: tuple[str, ...] = ()
    optional_keys: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    markers: tuple[str, ...] = CAPTIVE_MARKERS
    marker_mode: str = "exact"  # "exact": key == marker; "upper": upper(key) in markers
    coverage_targets: tuple[str, ...] = ()
    coverage_ratio: float = 0.35
    coverage_cap: int | None = None
    scan_rows: int | None = None  # search all rows for the table; a number searches only so many
    start_rule: str = "captive"  # captive | commission | referral
    extra_canonical: tuple[str, ...] = ()
    output_order: tuple[str, ...] | None = None
    drop_nuisance_headers: bool = True
    uniquify_headers: bool = False
    blank_header_as: str | None = None
    month_columns: tuple[str, ...] = ()
    year_columns: tuple[str, ...] = ()
    period_from: str = "month_year"  # month_year | year
    parse_firsts: bool = False  # captive cleans its first-value measures too
    per_file: bool = True  # consolidate each file on its own (group by file + keys)
    match_order: tuple[str, ...] = ()  # canonical names in header-matching order

    @property
    def canonical(self) -> tuple[str, ...]:
        """All canonical names in matching order (keys, measures, extras)."""
        seen: list[str] = []
        for c in self.match_order + self.keys + self.sums + self.firsts + self.extra_canonical:
            if c not in seen:
                seen.append(c)
        return tuple(seen)

    @property
    def column_names(self) -> dict[str, str]:
        """Canonical name -> DataFrame column name.  Spark resolves names without
        regard to case by default, so a later name equal to an earlier one up to
        case (``Retained at Property``) gets a `` (2)`` suffix."""
        out: dict[str, str] = {}
        seen: dict[str, int] = {}
        for c in self.canonical:
            n = seen.get(c.lower(), 0) + 1
            seen[c.lower()] = n
            out[c] = c if n == 1 else f"{c} ({n})"
        return out

    @property
    def measures(self) -> tuple[str, ...]:
        return tuple(c for c in self.sums if c not in self.firsts) + self.firsts

    def min_coverage(self) -> int:
        need = math.ceil(self.coverage_ratio * len(self.coverage_targets))
        return need if self.coverage_cap is None else min(self.coverage_cap, need)

    def with_(self, **kw) -> "ReportSpec":
        return replace(self, **kw)


CAPTIVE_SPEC = ReportSpec(
    name="captive",
    keys=(CAPTIVE_KEY, CAPTIVE_CLIENT),
    sums=tuple(c for c in CAPTIVE_TARGETS if c not in CAPTIVE_FIRSTS),
    firsts=CAPTIVE_FIRSTS,
    fill_keys=(CAPTIVE_KEY,),
    optional_keys=(CAPTIVE_CLIENT,),
    required=(CAPTIVE_KEY,),
    markers=CAPTIVE_MARKERS,
    marker_mode="exact",
    coverage_targets=CAPTIVE_TARGETS,
    start_rule="captive",
    extra_canonical=MONTH_COLUMN_CANDIDATES + YEAR_COLUMN_CANDIDATES,
    month_columns=MONTH_COLUMN_CANDIDATES,
    year_columns=YEAR_COLUMN_CANDIDATES,
    period_from="month_year",
    parse_firsts=True,
    match_order=(CAPTIVE_KEY, CAPTIVE_CLIENT) + CAPTIVE_TARGETS + MONTH_COLUMN_CANDIDATES + YEAR_COLUMN_CANDIDATES,
)

COMMISSION_SPEC = ReportSpec(
    name="commission",
    keys=(SALESPERSON, CAPTIVE_NAME, CLIENT_NAME),
    sums=COMMISSION_SUMS,
    firsts=COMMISSION_FIRSTS,
    fill_keys=(SALESPERSON, CAPTIVE_NAME),
    optional_keys=(),
    required=(SALESPERSON, CAPTIVE_NAME, CLIENT_NAME),
    markers=UPPER_MARKERS,
    marker_mode="upper",
    coverage_targets=COMMISSION_SUMS + COMMISSION_FIRSTS,
    start_rule="commission",
    output_order=COMMISSION_OUTPUT_ORDER,
    drop_nuisance_headers=False,
    year_columns=("Year",),
    period_from="year",
    match_order=(SALESPERSON, CAPTIVE_NAME, CLIENT_NAME) + COMMISSION_SUMS + COMMISSION_FIRSTS,
)

REFERRAL_SPEC = ReportSpec(
    name="referral",
    keys=(VENDOR, CAPTIVE_NAME, CLIENT_NAME),
    sums=REFERRAL_SUMS,
    firsts=REFERRAL_FIRSTS,
    fill_keys=(VENDOR, CAPTIVE_NAME),
    optional_keys=(CLIENT_NAME,),
    required=(VENDOR, CAPTIVE_NAME),
    markers=UPPER_MARKERS,
    marker_mode="upper",
    coverage_targets=REFERRAL_SUMS + REFERRAL_FIRSTS,
    coverage_cap=3,
    start_rule="referral",
    output_order=REFERRAL_OUTPUT_ORDER,
    drop_nuisance_headers=False,
    uniquify_headers=True,
    year_columns=("Year",),
    period_from="year",
    match_order=(VENDOR, CAPTIVE_NAME, CLIENT_NAME, "Year", "Referral Fee %") + REFERRAL_SUMS,
)

SPECS = {s.name: s for s in (CAPTIVE_SPEC, COMMISSION_SPEC, REFERRAL_SPEC)}
