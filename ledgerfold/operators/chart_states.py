"""Chart summaries as states that merge, one set for each file.

A file's rows give, for each entity and measure, the sum, the first value in row order and
its place; and for each month column its sum.  States of any files add up to those of their
union (sums add, the earliest place wins), in any order and grouping.  So a new or
replaced file costs its own states only, and the charts over all files come from states
alone, never from rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.text import entity_key
from ledgerfold.operators.file_charts import _number
from ledgerfold.operators.summaries import _ranked_top
from ledgerfold.spec import MONTH_NAMES


def entity_states(data: DataFrame, measures: Sequence[str], captive_col: str, client_col: str | None, order: Column, by: str = "file") -> DataFrame:
    """(by, measure, entity, total, first_value, first_row) of every file; entities
    without a number for a measure have no state there.  ``order`` must not depend on
    which other files are there."""
    place = F.struct(F.col(by).alias("of"), order.alias("row"))
    rows = data.select(F.col(by), entity_key(captive_col, client_col).alias("entity"), place.alias("r"), *(_number(data, m).alias(f"v{i}") for i, m in enumerate(measures)))
    aggs = []
    for i in range(len(measures)):
        at = F.when(F.col(f"v{i}").isNotNull(), F.col("r"))
        aggs += [F.sum(f"v{i}").alias(f"s{i}"), F.min_by(f"v{i}", at).alias(f"a{i}"), F.min(at).alias(f"f{i}")]
    wide = rows.filter(F.col("entity") != "").groupBy(by, "entity").agg(*aggs)
    parts = [F.struct(F.lit(m).alias("measure"), F.col(f"s{i}").alias("total"), F.col(f"a{i}").alias("first_value"), F.col(f"f{i}").alias("first_row")) for i, m in enumerate(measures)]
    return wide.select(by, "entity", F.inline(F.array(*parts))).filter(F.col("first_row").isNotNull())


def merge_entities(states: DataFrame) -> DataFrame:
    """(measure, entity, total, first_value, first_row) of the union."""
    return states.groupBy("measure", "entity").agg(
        F.sum("total").alias("total"), F.min_by("first_value", "first_row").alias("first_value"), F.min("first_row").alias("first_row")
    )


def top_of(merged: DataFrame, measure: str, n: int, take_first: bool = False) -> DataFrame:
    """(rank, label, value): the ``n`` best entities of merged states."""
    value = F.col("first_value" if take_first else "total")
    return _ranked_top(merged.filter(F.col("measure") == measure).select("entity", value.alias("value"), "first_row"), n)


def month_states(data: DataFrame, month_cols: Sequence[str], by: str = "file") -> DataFrame:
    """(by, month_idx, month, value) of every file that has a number in a month."""
    wide = data.groupBy(by).agg(*(F.sum(_number(data, c)).alias(f"m{i}") for i, c in enumerate(month_cols)))
    parts = [F.struct(F.lit(i + 1).alias("month_idx"), F.lit(MONTH_NAMES[i]).alias("month"), F.col(f"m{i}").alias("value")) for i in range(len(month_cols))]
    return wide.select(by, F.inline(F.array(*parts))).filter(F.col("value").isNotNull())


def merge_months(states: DataFrame) -> DataFrame:
    """(month_idx, month, value) of the union."""
    return states.groupBy("month_idx", "month").agg(F.sum("value").alias("value"))
