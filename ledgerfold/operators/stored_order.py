"""A table kept in one order, with pages by offset or after a row.

The rows are range-partitioned by the sort keys, sorted inside the partitions and
written once, with their place.  Beside them lies a zone map: for each partition the
number of rows before it, its own, and its last key.  A page by offset picks the
partitions that its ranks fall into; a page after a row (``seek``) those whose last
key lies beyond that row's.  Either reads only these, by a range of places that reaches
the Parquet scan; nothing is sorted or written again, in this session or another one.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators import explore as E
from ledgerfold.session import checkpoint_dir, release

_PLACE_BITS = 33  # how Spark's monotonically increasing ids are made

#: A sort key without nulls, and whether it descends.
Key = tuple[Column, bool]


class StoredOrder:
    """Rows in the order of some keys, which together tell all rows apart."""

    def __init__(self, spark: SparkSession, path: str):
        """Open the order stored under ``path``."""
        self.spark, self.path = spark, path
        self.rows = spark.read.parquet(f"{path}/rows")
        self.zones = spark.read.parquet(f"{path}/zones")
        self.keys = sorted((c for c in self.rows.columns if c.startswith("__key")), key=lambda c: int(c[5:].rstrip("d")))
        self.columns = [c for c in self.rows.columns if c not in self.keys and c != "__at"]
        # One small row for each partition.
        self._zones = sorted((r["part"], r["before"], r["n"]) for r in self.zones.select("part", "before", "n").collect())
        self.total = sum(n for *_, n in self._zones)

    @classmethod
    def build(cls, df: DataFrame, keys: Sequence[Key], path: str, partitions: int | None = None) -> "StoredOrder":
        spark = df.sparkSession
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        names = [f"__key{i}{'d' if desc else ''}" for i, (_, desc) in enumerate(keys)]  # the order travels in the names
        keyed = df.select("*", *(c.alias(k) for (c, _), k in zip(keys, names)))
        order = [F.col(k).desc() if k.endswith("d") else F.col(k).asc() for k in names]
        placed = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
        placed.write.mode("overwrite").parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
        zones = rows.groupBy(F.shiftright("__at", _PLACE_BITS).alias("part")).agg(
            F.count("*").alias("n"), F.max_by(F.struct(*names), "__at").alias("last")
        )
        found = zones.select("part", "n").collect()
        before, at = {}, 0
        for part, size in sorted(map(tuple, found)):
            before[part] = at
            at += size
        known = F.create_map(*(F.lit(x) for p, b in before.items() for x in (p, b))) if before else None
        zones = zones.withColumn("before", (known[F.col("part")] if known is not None else F.lit(0)).cast("long"))
        zones.coalesce(1).write.mode("overwrite").parquet(f"{path}/zones")
        return cls(spark, path)

    def _between(self, parts: Sequence[int]) -> DataFrame:
        if not parts:
            return self.rows.limit(0)
        return self.rows.filter((F.col("__at") >= F.lit(min(parts) << _PLACE_BITS)) & (F.col("__at") < F.lit((max(parts) + 1) << _PLACE_BITS)))

    def page(self, offset: int, size: int) -> DataFrame:
        """Rows of ranks offset + 1 .. offset + size, in order."""
        if size <= 0:
            return self.rows.limit(0).select(*self.columns)
        hit = [(p, b) for p, b, n in self._zones if b < offset + size and b + n > offset]
        near = self._between([p for p, _ in hit])
        if not hit:
            return near.select(*self.columns)
        before = F.create_map(*(F.lit(x) for p, b in hit for x in (p, b)))
        rank = before[F.shiftright("__at", _PLACE_BITS)] + F.col("__at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
        return near.filter((rank >= offset) & (rank < offset + size)).orderBy("__at").select(*self.columns)

    def _beyond(self, key: Mapping[str, object], prefix: str = "") -> Column:
        """Whether a row's keys (columns, or fields of ``prefix``) come after ``key``."""
        col = lambda k: F.col(f"{prefix}{k}")
        out, same = F.lit(False), F.lit(True)
        for k in self.keys:
            value = F.lit(key[k]).cast(self.rows.schema[k].dataType)
            out = out | (same & (col(k) < value if k.endswith("d") else col(k) > value))
            same = same & (col(k) == value)
        return out

    def key_of(self, condition: Column) -> dict[str, object] | None:
        """The sort keys of the first row that meets a condition."""
        row = self.rows.filter(condition).orderBy("__at").select(*self.keys).first()
        return row.asDict() if row else None

    def seek(self, key: Mapping[str, object] | None, size: int) -> DataFrame:
        """The ``size`` rows after the row with these keys (from the top without any), in order."""
        if key is None:
            return self.page(0, size)
        near = self.zones.filter(self._beyond(key, "last."))
        sizes = {p: n for p, _, n in self._zones}
        parts: list[int] = []
        whole = 0
        for part in sorted(r["part"] for r in near.select("part").collect()):
            parts.append(part)
            # All rows of the partitions behind the first lie beyond the key.
            whole += sizes[part] if len(parts) > 1 else 0
            if whole >= size:
                break
        return self._between(parts).filter(self._beyond(key)).orderBy("__at").limit(size).select(*self.columns)

    def close(self) -> None:
        """Delete what is stored."""
        release(self.spark, [self.path])


class TableView:
    """The explore view over one result table: search, facets, sort and pages.

    Each combination of search, facets and sort is stored once; every page of it comes
    from there.  The ``keep`` combinations used last stay, older ones are deleted."""

    def __init__(self, df: DataFrame, order_col: str, keep: int = 8):
        self.df, self.order_col, self.keep = df, order_col, keep
        self.orders: OrderedDict[tuple, StoredOrder] = OrderedDict()

    def order(self, search: str = "", facets: Mapping[str, Sequence[str]] | None = None, sort_column: str | None = None, direction: str = "asc") -> StoredOrder:
        """The stored order of a request."""
        import os
        import uuid

        chosen = tuple(sorted((c, tuple(sorted({str(v).strip() for v in vs}))) for c, vs in (facets or {}).items() if vs))
        sorted_by = (sort_column, direction) if sort_column and direction in ("asc", "desc") else None
        request = ((search or "").strip().lower(), chosen, sorted_by)
        if request not in self.orders:
            rows = E.facet_filter(E.search_rows(self.df, search), facets or {})
            keys: list[Key] = [(F.col(self.order_col), False)]
            if sorted_by:
                keys = E.sort_values(self.df, sort_column, direction) + keys
            path = os.path.join(checkpoint_dir(self.df.sparkSession), "orders", uuid.uuid4().hex)
            self.orders[request] = StoredOrder.build(rows, keys, path)
            while len(self.orders) > self.keep:
                self.orders.popitem(last=False)[1].close()
        self.orders.move_to_end(request)
        return self.orders[request]

    def page(self, page_index: int = 0, page_size: int = E.DEFAULT_PAGE_SIZE, **request) -> DataFrame:
        """One page; the index is clamped to the last one."""
        order = self.order(**request)
        size = page_size if page_size in E.PAGE_SIZES else E.DEFAULT_PAGE_SIZE
        return order.page(E.page_bounds(order.total, page_index, size)[1], size)

    def close(self) -> None:
        while self.orders:
            self.orders.popitem()[1].close()
