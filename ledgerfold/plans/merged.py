"""Merge of two ingested report sets, pair by pair, in one job.

A pair names a file of each set.  It merges when both files are sound and their
table periods agree; otherwise it gets a status row with the reason and gives no
data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.operators.merge import merge_metadata, merge_reports, periods_match
from ledgerfold.plans.reports import Ingested
from ledgerfold.session import materialize
from ledgerfold.sources.files import NOT_READ
from ledgerfold.spec import CAPTIVE_SPEC, ReportSpec


@dataclass
class Merged:
    data: DataFrame
    metadata: DataFrame
    status: DataFrame


def merge_ingested(left: Ingested, right: Ingested, pairs: DataFrame, spec: ReportSpec = CAPTIVE_SPEC,
                   left_tag: str = "RLIP", right_tag: str = "RAP") -> Merged:
    """``pairs``: (pair, left_file, right_file), one row for each pair; the data
    have ``pair`` in place of ``file``."""
    sides = []
    for got, col, tag in ((left, "left_file", left_tag), (right, "right_file", right_tag)):
        named = pairs.select("pair", F.col(col).alias("file"))
        fault = named.join(got.status, "file", "left").select(
            "pair", F.when(F.col("status").isNull(), F.lit(NOT_READ)).when(F.col("status") != "ok", F.col("error")).alias("fault"),
        )
        fault = fault.select("pair", F.when(F.col("fault").isNotNull(), F.concat(F.lit(f"{tag} file: "), "fault")).alias(f"fault_{tag}"))
        sides.append((named, fault, named.join(got.metadata, "file").drop("file")))
    (left_named, left_fault, left_meta), (right_named, right_fault, right_meta) = sides
    check = periods_match(left_meta, right_meta, ["pair"]).withColumnRenamed("error", "differs")
    error = F.coalesce(f"fault_{left_tag}", f"fault_{right_tag}", "differs")
    status = materialize(
        left_fault.join(right_fault, "pair").join(check, "pair", "left")
        .select("pair", F.when(error.isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"), error.alias("error"))
    )
    good = status.filter("status = 'ok'").select("pair")
    halves = [got.data.join(named.join(good, "pair"), "file").drop("file") for got, named in ((left, left_named), (right, right_named))]
    data = merge_reports(*halves, spec, left_tag, right_tag, period_col="pair")
    metadata = merge_metadata(left_meta.join(good, "pair"), right_meta.join(good, "pair"), ["pair"])
    return Merged(data, metadata, status)
