"""Publication: whole or not at all, file by file; states that merge."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import chart_states as C
from ledgerfold.plans.publish import Publication


def _path():
    return os.path.join(tempfile.mkdtemp(prefix="ledgerfold-publish-"), "p")


def _set(spark, rows):
    data = spark.createDataFrame(rows, "file string, v long")
    return {"data": data, "status": data.groupBy("file").agg(F.sum("v").alias("total"))}, data.select("file")


def _seen(out, version=None):
    return sorted(map(tuple, out.read("data", version).select("file", "v").collect())), sorted(map(tuple, out.read("status", version).collect()))


def test_a_file_is_replaced_alone(spark):
    out = Publication(spark, _path())
    assert out.version() == 0 and out.manifest().count() == 0
    assert out.publish(*_set(spark, [("a", 1), ("a", 2), ("b", 5)])) == 1
    before = {p for d, _, fs in os.walk(out.path) for p in (os.path.join(d, f) for f in fs)}
    assert out.publish(*_set(spark, [("a", 7), ("c", 9)])) == 2
    assert _seen(out) == ([("a", 7), ("b", 5), ("c", 9)], [("a", 7), ("b", 5), ("c", 9)])
    assert _seen(out, 1) == ([("a", 1), ("a", 2), ("b", 5)], [("a", 3), ("b", 5)])
    assert all(map(os.path.exists, before))
    out.publish(_set(spark, [("b", 5)])[0], spark.createDataFrame([("a",), ("b",)], "file string"))  # a has no rows any more
    assert _seen(out)[0] == [("b", 5), ("c", 9)]


def test_a_failure_between_the_tables_changes_nothing(spark):
    out = Publication(spark, _path())
    out.publish(*_set(spark, [("a", 1)]))
    tables, files = _set(spark, [("a", 2)])
    broken = files.withColumn("total", F.expr("cast(raise_error('lost') as long)"))
    with pytest.raises(Exception, match="lost"):
        out.publish({"data": tables["data"], "status": broken}, files)
    assert out.version() == 1 and _seen(out) == ([("a", 1)], [("a", 1)])


def test_two_at_the_same_time(spark, monkeypatch):
    out, other = Publication(spark, _path()), None
    out.publish(*_set(spark, [("a", 1), ("b", 1)]))
    plain, calls = Publication._install, []

    def late(self, made, version):
        if not calls:
            calls.append(1)
            Publication(spark, out.path).publish(*_set(spark, [("b", 2)]))  # takes the number first
        return plain(self, made, version)

    monkeypatch.setattr(Publication, "_install", late)
    assert out.publish(*_set(spark, [("a", 3)])) == 3
    assert _seen(out)[0] == [("a", 3), ("b", 2)]


def test_states_merge_in_any_grouping(spark):
    rows = [("f1", "A", "x", 1, 5.0), ("f1", "A", "x", 2, 7.0), ("f1", "B", "", 3, None), ("f2", "A", "x", 0, 100.0), ("f2", " ", None, 1, 3.0), ("f0", "B", "", 9, 4.0)]
    df = spark.createDataFrame(rows, "file string, cap string, cli string, n int, v double")
    states = C.entity_states(df, ["v"], "cap", "cli", F.col("n"))
    whole = sorted((r.entity, r.total, r.first_value) for r in C.merge_entities(states).collect())
    assert whole == [("A | x", 112.0, 5.0), ("B", 4.0, 4.0)]
    part = C.merge_entities(states.filter("file <> 'f1'")).unionByName(C.merge_entities(states.filter("file = 'f1'")))
    assert sorted((r.entity, r.total, r.first_value) for r in C.merge_entities(part).collect()) == whole
    months = C.month_states(df, ["v", "n"])
    assert sorted((r.month, r.value) for r in C.merge_months(months).collect()) == [("February", 16.0), ("January", 119.0)]
