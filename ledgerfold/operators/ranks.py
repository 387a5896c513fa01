"""Row ranks and pages of a whole ordering, without one task that holds it all.

The rows are range-partitioned by the sort keys, sorted inside the partitions and
written once.  The id that Spark gives a row at that point is its partition and
its place in it, so a rank is the place plus the number of rows in the partitions
before: one small row per partition.  A page reads only the partitions it
overlaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.session import materialize

_PLACE_BITS = 33  # how Spark's monotonically increasing ids are made


class Ranked:
    """Rows in the order of some keys, which must tell all rows apart."""

    def __init__(self, df: DataFrame, keys: Sequence[Column], partitions: int | None = None):
        n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.columns = df.columns
        ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        self.rows = materialize(ordered.withColumn("__at", F.monotonically_increasing_id()))
        part = F.shiftright("__at", _PLACE_BITS)
        # One row per partition.
        counts = sorted((r["p"], r["n"]) for r in self.rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
        self.before: dict[int, int] = {}
        self.total = 0
        for p, rows in counts:
            self.before[p] = self.total
            self.total += rows

    def with_rank(self, name: str = "rank") -> DataFrame:
        """All rows with their rank from 1."""
        return self._ranked(self.rows, self.before, name).drop("__at")

    def slice(self, offset: int, size: int) -> DataFrame:
        """Rows of ranks offset + 1 .. offset + size, in order."""
        ends = {p: b for p, b in zip(self.before, [*list(self.before.values())[1:], self.total])}
        hit = {p: b for p, b in self.before.items() if b < offset + size and ends[p] > offset}
        if not hit or size <= 0:
            return self.rows.select(*self.columns).limit(0)
        low, high = min(hit) << _PLACE_BITS, (max(hit) + 1) << _PLACE_BITS
        near = self._ranked(self.rows.filter((F.col("__at") >= low) & (F.col("__at") < high)), hit, "__rank")
        page = near.filter((F.col("__rank") > offset) & (F.col("__rank") <= offset + size))
        return page.orderBy("__rank").select(*self.columns)

    @staticmethod
    def _ranked(rows: DataFrame, before: dict[int, int], name: str) -> DataFrame:
        if not before:
            return rows.withColumn(name, F.lit(0).cast("long"))
        table = ", ".join(f"{p}L, {b}L" for p, b in before.items())
        place = f"(__at & {(1 << _PLACE_BITS) - 1}L)"
        return rows.withColumn(name, F.expr(f"element_at(map({table}), shiftright(__at, {_PLACE_BITS})) + {place} + 1"))
