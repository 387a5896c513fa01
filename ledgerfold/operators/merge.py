"""Merge of two half-reports (RLIP and RAP) by a full outer join.

Per-column rules: RLIP columns come from the left, RAP columns from the right,
first-value columns take the left value, else the right; every other measure
is the sum of both sides; nulls count as 0.  Keys are coalesced by the
using-join, so right-only keys keep their names, and right-only columns are
kept (the union of both sides' columns).

Both sides are consolidated reports (one row per key), so the join has no
skewed keys; with ``period_col`` the period joins the keys, which merges many
report pairs of many periods in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.spec import CAPTIVE_SPEC, ReportSpec


def merge_reports(
    left: DataFrame,
    right: DataFrame,
    spec: ReportSpec = CAPTIVE_SPEC,
    left_tag: str = "RLIP",
    right_tag: str = "RAP",
    period_col: str | None = None,
    sort: bool = False,
) -> DataFrame:
    keys = list(spec.keys) + ([period_col] if period_col else [])
    l_meas = [c for c in left.columns if c not in keys]
    r_meas = [c for c in right.columns if c not in keys]
    measures = l_meas + [c for c in r_meas if c not in l_meas]
    l = left.select(*keys, *[F.col(c).alias(f"__l{i}") for i, c in enumerate(measures) if c in l_meas])
    r = right.select(*keys, *[F.col(c).alias(f"__r{i}") for i, c in enumerate(measures) if c in r_meas])
    j = l.join(r, keys, "full_outer")

    zero = F.lit(0.0)
    out = [F.col(k) for k in keys]
    for i, c in enumerate(measures):
        lc = F.col(f"__l{i}") if c in l_meas else None
        rc = F.col(f"__r{i}") if c in r_meas else None
        if left_tag in c:
            e = F.coalesce(lc if lc is not None else rc, zero)
        elif right_tag in c:
            e = F.coalesce(rc if rc is not None else lc, zero)
        elif c in spec.firsts:
            e = F.coalesce(*[x for x in (lc, rc) if x is not None], zero)
        elif lc is not None and rc is not None:
            e = F.coalesce(lc, zero) + F.coalesce(rc, zero)
        else:
            e = F.coalesce(lc if lc is not None else rc, zero)
        out.append(e.alias(c))
    res = j.select(*out)
    return res.orderBy(*keys) if sort else res


def periods_match(left_period: DataFrame, right_period: DataFrame, on: Sequence[str], col: str = "canonical_period") -> DataFrame:
    """``ok`` when the two formatted table periods of a pair are equal (null =
    null passes) and the error text otherwise -- checked before a merge.  The
    pairs meet by a full outer join on their keys ``on`` (a pair missing on one
    side compares with null)."""
    keys = list(on)
    both = left_period.select(*keys, F.col(col).alias("l")).join(right_period.select(*keys, F.col(col).alias("r")), keys, "full_outer")
    same = F.col("l").eqNullSafe(F.col("r"))
    return both.select(
        *keys,
        same.alias("ok"),
        F.when(
            ~same,
            F.concat(
                F.lit("Cannot merge: RLIP file period is "), F.coalesce(F.col("l"), F.lit("None")),
                F.lit(", RAP file period is "), F.coalesce(F.col("r"), F.lit("None")),
                F.lit(". Table month/year must match."),
            ),
        ).alias("error"),
    )


def merge_metadata(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
) -> DataFrame:
    """Metadata of a merged pair: first non-null of the two for the period fields,
    notes concatenated, file names listed, ``file_type = 'merged'``."""
    fields = ("canonical_period", "period_from_filename", "period_from_header")
    l = left.select(*on, *[F.col(f).alias(f"l_{f}") for f in fields],
                    F.col("discrepancy_notes").alias("l_notes"), F.col("filename").alias("l_file"))
    r = right.select(*on, *[F.col(f).alias(f"r_{f}") for f in fields],
                     F.col("discrepancy_notes").alias("r_notes"), F.col("filename").alias("r_file"))
    j = l.join(r, list(on), "full_outer")
    empty = F.array().cast("array<string>")
    return j.select(
        *on,
        F.col("l_canonical_period").alias("canonical_period"),
        *[F.coalesce(F.col(f"l_{f}"), F.col(f"r_{f}")).alias(f) for f in fields[1:]],
        F.concat(F.coalesce("l_notes", empty), F.coalesce("r_notes", empty)).alias("discrepancy_notes"),
        F.lit("merged").alias("file_type"),
        F.filter(F.array(F.col("l_file"), F.col("r_file")), lambda x: x.isNotNull()).alias("filenames"),
        F.array(F.lit("RLIP-only"), F.lit("RAP-only")).alias("merged_from"),
    )
