"""Pages of a stored order against a plain sort."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators.stored_order import StoredOrder, TableView


def _path():
    return os.path.join(tempfile.mkdtemp(prefix="ledgerfold-order-"), "o")


@pytest.fixture(scope="module")
def order(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(20) / 2, rng.choice("xyz")) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v double, t string")
    stored = StoredOrder.build(df, [(F.col("v"), True), (F.col("t"), False), (F.col("id"), False)], _path(), 6)
    return stored, sorted(rows, key=lambda r: (-r[1], r[2], r[0]))


def test_offsets_and_seeks(spark, order):
    stored, want = order
    assert stored.total == 500
    again = StoredOrder(spark, stored.path)
    for offset, size in ((0, 10), (83, 40), (490, 50), (500, 5), (0, 500), (7, 0)):
        assert [tuple(r) for r in again.page(offset, size).collect()] == want[offset:offset + size]
    for at, size in ((0, 5), (82, 1), (200, 150), (498, 10), (499, 10)):
        key = stored.key_of(F.col("id") == want[at][0])
        assert [tuple(r) for r in stored.seek(key, size).collect()] == want[at + 1:at + 1 + size]
    assert [tuple(r) for r in stored.seek(None, 3).collect()] == want[:3]


def test_a_page_reads_its_partitions_only(order):
    stored, _ = order
    plan = stored.page(83, 40)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(__at," in plan and "LessThan(__at," in plan and "Exchange rangepartitioning" in plan
    assert len({r.p for r in stored._between([2]).select(F.shiftright("__at", 33).alias("p")).collect()}) == 1


def test_a_view_stores_each_order_once(spark, monkeypatch):
    rows = [(i, None if i % 5 == 0 else ("NaN" if i % 7 == 0 else str(i % 13)), ["Émil", "emil", None, "Zoe", "abe"][i % 5]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, v string, name string")
    built = []
    plain = StoredOrder.build.__func__
    monkeypatch.setattr(StoredOrder, "build", classmethod(lambda cls, *a, **k: built.append(1) or plain(cls, *a, **k)))
    view = TableView(df, "id", keep=2)
    names = [r.name for i in range(3) for r in view.page(i, 50, sort_column="name").collect()]
    assert len(built) == 1 and names[:24] == [None] * 24 and names[24:48] == ["abe"] * 24 and names[-24:] == ["Zoe"] * 24 and len(names) == 120
    assert [r.id for r in view.page(99, 50, sort_column="name").collect()] == [r[0] for r in rows if r[2] == "Zoe"][-20:]
    assert view.order(search=" EMIL ", facets={"v": ["1", " 2 "]}).total == sum(r[1] in ("1", "2") and (r[2] or "").lower() in ("emil",) for r in rows)
    paths = [o.path for o in view.orders.values()]
    view.page(0, sort_column="v", direction="desc")
    assert len(built) == 3 and not os.path.exists(paths[0]) and os.path.exists(paths[1])
    view.close()
    assert not os.path.exists(paths[1])


def test_empty(spark):
    stored = StoredOrder.build(spark.createDataFrame([], "id long"), [(F.col("id"), False)], _path())
    assert stored.total == 0 and stored.page(0, 5).count() == 0 and stored.seek(None, 5).count() == 0
