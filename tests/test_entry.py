"""Driver contract and plan shape."""

import duckdb

import __spark_entry__ as E
from tools.oracle_check import frame_hash, of_duckdb, of_spark

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def test_contract(spark, sf_small):
    df = E.entry(spark)
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


def _duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def test_some_oracles_small(spark, sf_small):
    con = _duck(sf_small)
    for name in ("consolidate", "top_n_others", "merge_reports", "period_from_name", "captive_report", "table_start", "merge_report_status"):
        s = of_spark(E.queries()[name](spark, sf_small))
        d = of_duckdb(con, E.oracle_sql()[name])
        assert sorted(s[0]) == sorted(d[0]), name
        assert frame_hash(s) == frame_hash(d), name


def test_scan_prunes_columns(spark, sf_small):
    """first_in_group reads three order columns, not the whole table."""
    plan = E.queries()["first_in_group"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "o_orderpriority" in schema and "o_totalprice" not in schema and "o_orderdate" not in schema


def test_filter_pushed_to_scan(spark, sf_small):
    """Facet selections reach the orders scan as pushed filters."""
    plan = E.queries()["facet_filter"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):].split("\n")[0]
    assert "o_orderstatus" in pushed and "o_orderpriority" in pushed


def test_forward_fill_has_no_global_window(spark):
    from ledgerfold.operators.clean import forward_fill

    df = spark.createDataFrame([("f", 1, "a"), ("f", 2, None)], "file string, row_idx long, v string")
    plan = forward_fill(df, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
