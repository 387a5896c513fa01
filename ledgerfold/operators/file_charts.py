"""The chart tables of many consolidated files in one job.

Every chart of every file comes from one aggregate by (file, entity): the sums and
first values of all charted measures side by side, unpivoted to ``(file, chart,
label, value)`` and ranked per file and chart.  Ranks keep the best few per task before the
shuffle, so a file with very many entities never lands in one task whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions.numbers import lenient_float
from ledgerfold.functions.text import entity_key

SCHEMA = "chart string, rank int, label string, value double, percent double"


@dataclass(frozen=True)
class Chart:
    """A ranked chart: ``top`` entities by the sum of a measure, or by its first
    value; with ``others`` a last slice for the rest, and percents."""

    name: str
    measure: str
    top: int
    take_first: bool = False
    others: bool = False


def _number(df: DataFrame, col: str) -> Column:
    return lenient_float(col) if dict(df.dtypes)[col] == "string" else F.col(col).cast("double")


def _by_entity(df: DataFrame, charts: Sequence[Chart], by: str, key: Column, order: Column) -> DataFrame:
    """(by, chart, label, value, first_row) of every entity with a number for the chart's measure."""
    rows = df.select(F.col(by), key.alias("label"), order.alias("r"), *(_number(df, c.measure).alias(f"v{i}") for i, c in enumerate(charts)))
    aggs = []
    for i, c in enumerate(charts):
        at = F.when(F.col(f"v{i}").isNotNull(), F.col("r"))
        aggs += [(F.min_by(f"v{i}", at) if c.take_first else F.sum(f"v{i}")).alias(f"a{i}"), F.min(at).alias(f"f{i}")]
    wide = rows.filter(F.col("label") != "").groupBy(by, "label").agg(*aggs)
    parts = [F.struct(F.lit(c.name).alias("chart"), F.col(f"a{i}").alias("value"), F.col(f"f{i}").alias("first_row")) for i, c in enumerate(charts)]
    return wide.select(by, "label", F.inline(F.array(*parts))).filter(F.col("first_row").isNotNull())


def chart_tables(df: DataFrame, charts: Sequence[Chart], captive_col: str, client_col: str | None, order: Column, by: str = "file",
                 share: tuple[str, str] | None = None) -> DataFrame:
    """(by, chart, rank, label, value, percent) of every file; ``share`` names two
    measures whose totals are set against each other (chart ``share``).  A measure
    that a file lacks gives that file no rows; Others appears only above zero;
    a zero total gives no slices."""
    ent = _by_entity(df, charts, by, entity_key(captive_col, client_col), order)
    place = F.row_number().over(Window.partitionBy(by, "chart").orderBy(F.desc("value"), "first_row"))
    most = max(c.top for c in charts)
    top_of = F.create_map(*(F.lit(x) for c in charts for x in (c.name, c.top)))
    top = ent.withColumn("rank", place).filter(F.col("rank") <= most).filter(F.col("rank") <= top_of[F.col("chart")])
    plain = [c.name for c in charts if not c.others]
    out = top.filter(F.col("chart").isin(plain)).select(by, "chart", "rank", "label", "value", F.lit(None).cast("double").alias("percent"))

    pies = [c for c in charts if c.others]
    if pies:
        names = [c.name for c in pies]
        slices = top.filter(F.col("chart").isin(names))
        flagged = ent.filter(F.col("chart").isin(names)).join(slices.select(by, "chart", "label", F.lit(True).alias("on_top")), [by, "chart", "label"], "left")
        rest = F.sum(F.when(F.col("on_top").isNull(), F.col("value")))
        totals = flagged.groupBy(by, "chart").agg(F.sum("value").alias("total"), rest.alias("rest")).filter(F.col("total") != 0)
        others = totals.filter(F.col("rest") > 0).select(by, "chart", (top_of[F.col("chart")] + 1).alias("rank"), F.lit("Others").alias("label"), F.col("rest").alias("value"))
        pie = slices.select(by, "chart", "rank", "label", "value").unionByName(others).join(totals.select(by, "chart", "total"), [by, "chart"])
        out = out.unionByName(pie.select(by, "chart", "rank", "label", "value", F.round(100.0 * F.col("value") / F.col("total"), 2).alias("percent")))

    if share:
        totals = df.groupBy(by).agg(*(F.sum(_number(df, m)).alias(f"s{i}") for i, m in enumerate(share))).filter("s0 IS NOT NULL AND s1 IS NOT NULL")
        both = F.col("s0") + F.col("s1")
        two = [F.struct(F.lit("share").alias("chart"), F.lit(i + 1).alias("rank"), F.lit(m).alias("label"), F.col(f"s{i}").alias("value"),
                        F.when(both == 0, F.lit(0.0)).otherwise(F.round(100.0 * F.col(f"s{i}") / both, 2)).alias("percent")) for i, m in enumerate(share)]
        out = out.unionByName(totals.select(by, F.inline(F.array(*two))))
    return out
