"""Chart summaries over a consolidated table.

Outputs are small DataFrames ``(rank, label, value[, percent])``.  Top-k uses
``orderBy(...).limit(n)`` which Spark plans as TakeOrderedAndProject: each task
keeps its own n best rows, so no task ever holds all entities.  Totals are
one-row aggregates joined back on a constant key (broadcast of one row).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.numbers import lenient_float
from ledgerfold.functions.text import entity_key
from ledgerfold.spec import CHART_ALIASES, MONTH_NAMES


def resolve_column(columns: Sequence[str], canonical: str, aliases: dict | None = None) -> str | None:
    """First column in frame order equal to the canonical name or one of its aliases."""
    aliases = CHART_ALIASES if aliases is None else aliases
    candidates = {canonical} | {a for a, c in aliases.items() if c == canonical}
    for c in columns:
        if c in candidates:
            return c
    return None


def _value(df: DataFrame, col: str) -> Column:
    kind = dict(df.dtypes)[col]
    if kind == "string":
        return lenient_float(col)
    return F.col(col).cast("double")


def aggregate_by_entity(
    df: DataFrame,
    value_col: str,
    captive_col: str,
    client_col: str | None,
    order_col: str,
    take_first: bool = False,
) -> DataFrame:
    """``(entity, value, first_row)``: rows with an empty key or a non-numeric value
    are skipped; value is the sum, or the first numeric value in row order."""
    key = entity_key(captive_col, client_col)
    rows = df.select(
        key.alias("entity"), _value(df, value_col).alias("v"), F.col(order_col).alias("r")
    ).filter((F.col("entity") != "") & F.col("v").isNotNull())
    agg = F.min_by("v", "r") if take_first else F.sum("v")
    return rows.groupBy("entity").agg(agg.alias("value"), F.min("r").alias("first_row"))


def top_entities(
    df: DataFrame,
    value_col: str,
    n: int,
    captive_col: str,
    client_col: str | None = None,
    order_col: str = "row_idx",
    take_first: bool = False,
) -> DataFrame:
    """Top ``n`` entities by value, ties in first-seen order -> (rank, label, value)."""
    ent = aggregate_by_entity(df, value_col, captive_col, client_col, order_col, take_first)
    return _ranked_top(ent, n)


def _ranked_top(ent: DataFrame, n: int) -> DataFrame:
    """The ``n`` best entities (value desc, first row asc), numbered 1..n.

    ``orderBy().limit(n)`` keeps n rows per task (TakeOrderedAndProject); the
    numbering then sorts those n rows inside one aggregate row (a bounded
    ``collect_list``), so no window moves data to a single partition."""
    top = ent.orderBy(F.col("value").desc(), F.col("first_row").asc()).limit(n)
    ordered = top.agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("value"), F.col("first_row"), F.col("entity"))),
            lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1)
            .when(a["first_row"] < b["first_row"], -1).when(a["first_row"] > b["first_row"], 1).otherwise(0),
        ).alias("top")
    )
    return ordered.select(F.posexplode("top").alias("pos", "t")).select(
        (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.entity").alias("label"), F.col("t.value").alias("value")
    )


def top_n_others(
    df: DataFrame,
    value_col: str,
    n: int,
    captive_col: str,
    client_col: str | None = None,
    order_col: str = "row_idx",
) -> DataFrame:
    """Top ``n`` slices plus ``Others`` (only when the rest is positive), with
    percent of the total rounded to 2; a zero total gives no slices."""
    ent = aggregate_by_entity(df, value_col, captive_col, client_col, order_col)
    top_ranked = _ranked_top(ent, n)
    # The top holds at most n rows: a proven bound, so broadcasting it is safe.
    flags = F.broadcast(top_ranked.select(F.col("label").alias("entity"), F.lit(True).alias("is_top")))
    totals = (
        ent.join(flags, "entity", "left")
        .agg(
            F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"),
            F.coalesce(F.sum(F.when(F.col("is_top").isNull(), F.col("value"))), F.lit(0.0)).alias("rest"),
            F.count(F.when(F.col("is_top").isNull(), 1)).alias("n_rest"),
        )
        .withColumn("_k", F.lit(1))
    )
    others = totals.select(
        F.lit(n + 1).cast("int").alias("rank"), F.lit("Others").alias("label"), F.col("rest").alias("value"), "_k"
    ).filter(F.col("value") > 0)
    slices = top_ranked.withColumn("_k", F.lit(1)).unionByName(others)
    one_row = F.broadcast(totals.select("_k", "total"))
    return (
        slices.join(one_row, "_k")
        .filter(F.col("total") != 0)
        .select("rank", "label", "value", F.round(100.0 * F.col("value") / F.col("total"), 2).alias("percent"))
    )


def share_of_two(df: DataFrame, col_a: str, col_b: str, label_a: str | None = None, label_b: str | None = None) -> DataFrame:
    """Two slices: totals of two measures and their percent of the combined total;
    a zero combined total gives two zero slices."""
    label_a = label_a or col_a
    label_b = label_b or col_b
    tot = df.agg(
        F.coalesce(F.sum(_value(df, col_a)), F.lit(0.0)).alias("a"),
        F.coalesce(F.sum(_value(df, col_b)), F.lit(0.0)).alias("b"),
    )
    both = F.col("a") + F.col("b")
    pct = lambda x: F.when(both == 0, F.lit(0.0)).otherwise(F.round(100.0 * x / both, 2))
    return tot.select(
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("rank"), F.lit(label_a).alias("label"), F.col("a").alias("value"), pct(F.col("a")).alias("percent")),
                F.struct(F.lit(2).alias("rank"), F.lit(label_b).alias("label"), F.col("b").alias("value"), pct(F.col("b")).alias("percent")),
            )
        )
    )


def monthly_totals(df: DataFrame, month_cols: Sequence[str], labels: Sequence[str] = MONTH_NAMES) -> DataFrame:
    """Sum each month column over all rows -> ``(month_idx, month, value)`` in
    calendar order.  A missing column is an error naming the missing ones, sorted."""
    missing = sorted(set(month_cols) - set(df.columns))
    if missing:
        raise ValueError(f"Missing commission columns: {missing}")
    tot = df.agg(*[F.coalesce(F.sum(_value(df, c)), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(month_cols, 1)])
    return tot.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("month_idx"), F.lit(labels[i - 1]).alias("month"), F.col(f"m{i}").alias("value"))
                    for i in range(1, len(month_cols) + 1)
                ]
            )
        )
    )


def shuffle_points(df: DataFrame, seed: int = 7) -> DataFrame:
    """Chart points with a random display place (from 1), pairs kept together, in that
    order.  The order is that of a digest of seed and label, so it depends on neither
    partitions nor row order.  A chart's points are few: they are numbered inside one aggregate."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("label")))
    points = df.agg(F.array_sort(F.collect_list(F.struct(key.alias("__key"), *df.columns))).alias("points"))
    return points.select(F.posexplode("points").alias("pos", "p")).select(
        *(F.col(f"p.{c}").alias(c) for c in df.columns), (F.col("pos") + 1).cast("int").alias("place")
    )
