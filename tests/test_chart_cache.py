"""Charts of many files, and their cache by content."""

import os
import random
import tempfile

from pyspark.sql import functions as F

from ledgerfold.operators.file_charts import Chart, chart_tables
from ledgerfold.operators import summaries
from ledgerfold.plans.chart_cache import ChartCache, fingerprints
from ledgerfold.spec import CAPTIVE_CLIENT as CLIENT, CAPTIVE_KEY as KEY

RENT, UNITS, RLIP, RAP = "Additional Rent", "Total Available Units", "POPIC Fee RLIP", "POPIC Fee RAP"


def _order():
    return F.struct(F.col(KEY), F.col(CLIENT))


SCHEMA = f"file string, `{KEY}` string, `{CLIENT}` string, `{RENT}` double, `{UNITS}` double, `{RLIP}` double, `{RAP}` double"


def _rows(files, entities=12, seed=1):
    rng = random.Random(seed)
    num = lambda: rng.choice([None, 0.0, float(rng.randrange(-50, 500))])
    return [(f, f"Cap {e}", rng.choice(["", "A", "B"]), num(), num(), num(), num()) for f in files for e in range(rng.randrange(1, entities)) for _ in range(2)]


def test_equals_the_charts_of_one_file(spark):
    rows = [r + (i,) for i, r in enumerate(_rows([f"f{k}" for k in range(4)]) + [("odd", "", "", 1.0, None, None, None), ("zero", "z", "", 0.0, 0.0, 0.0, 0.0)])]
    df = spark.createDataFrame(rows, SCHEMA + ", n int")
    charts = [Chart("rent", RENT, 7), Chart("units", UNITS, 5, take_first=True), Chart("pie", RLIP, 4, others=True)]
    got = {}
    for r in chart_tables(df, charts, KEY, CLIENT, F.col("n"), share=(RLIP, RAP)).collect():
        got.setdefault((r.file, r.chart), set()).add((r["rank"], r.label, r.value, r.percent))
    for f in ("f0", "f2", "odd", "zero"):
        one = df.filter(F.col("file") == f)
        sets = {
            "rent": {(*r, None) for r in summaries.top_entities(one, RENT, 7, KEY, CLIENT, "n").collect()},
            "units": {(*r, None) for r in summaries.top_entities(one, UNITS, 5, KEY, CLIENT, "n", True).collect()},
            "pie": {tuple(r) for r in summaries.top_n_others(one, RLIP, 4, KEY, CLIENT, "n").collect()},
        }
        for chart, rows_ in sets.items():
            assert got.get((f, chart), set()) == rows_, (f, chart)
        if f.startswith("f"):
            assert got[f, "share"] == {tuple(r) for r in summaries.share_of_two(one, RLIP, RAP).collect()}


def test_hits_misses_and_clearing(spark):
    data = spark.createDataFrame(_rows(["a", "b", "c"]) + [("empty", "x", "", None, None, None, None)], SCHEMA)
    data = data.unionByName(data.filter("file = 'a'").withColumn("file", F.lit("twin of a")))
    cache = ChartCache(spark, os.path.join(tempfile.mkdtemp(prefix="ledgerfold-charts-"), "t"))
    states, charts = cache.tables(data, _order())
    assert {r.state for r in states.collect()} == {"miss"}
    first = sorted(map(str, charts.collect()))
    assert cache._stored_keys().count() == 4  # the twins share theirs; the file without a chart has one
    states, charts = cache.tables(data.repartition(7).orderBy(F.rand(3)), _order())
    assert {r.state for r in states.collect()} == {"hit"} and sorted(map(str, charts.collect())) == first

    other = data.withColumn(RENT, F.when(F.col("file") == "b", F.lit(1.0)).otherwise(F.col(RENT)))
    states, _ = cache.tables(other, _order())
    assert {r.file for r in states.collect() if r.state == "miss"} == {"b"}
    gone = cache.keep_only(fingerprints(other, version=cache.version))
    assert gone.count() == 1 and cache._stored_keys().count() == 4
    assert {r.state for r in cache.tables(other, _order())[0].collect()} == {"hit"}
    assert cache.keep_only(fingerprints(other, version=cache.version)).count() == 0
    cache.keep_only(spark.createDataFrame([], "key string"))
    assert cache.entries().count() == 0
    assert {r.state for r in cache.tables(data, _order())[0].collect()} == {"miss"}


def test_fingerprints_tell_content(spark):
    rows = [("a", None, "x", 1.0), ("b", "x", None, 1.0), ("c", None, "x", 1.0), ("d", None, "x", 1.0), ("d", None, "x", 1.0), ("e", None, "x", None)]
    df = spark.createDataFrame(rows, "file string, p string, q string, v double")
    key = {r.file: r.key for r in fingerprints(df).collect()}
    assert key["a"] == key["c"] and len(set(key.values())) == 4
    assert {r.key for r in fingerprints(df, version="2").collect()}.isdisjoint(key.values())
