"""Edge rules of the row, group, chart, merge and explore operators
(FIXTURES.md §5), checked on small frames and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerfold.functions.numbers import accounting_number, lenient_float
from ledgerfold.functions.text import entity_key, truncate_middle
from ledgerfold.operators import clean, consolidate as cons, explore as X, merge as M, summaries as S
from ledgerfold.spec import CAPTIVE_SPEC, COMMISSION_COMMISSION


def test_accounting_parse(spark):
    vals = ["($1,234.50)", "$ (12)", "  7 ", "", "12%", "(-5)", "1e3", None, "1_000", "nan"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.x for r in df.select(accounting_number("v").alias("x")).collect()]
    assert got == [-1234.5, -12.0, 7.0, 0.0, 0.0, 0.0, 1000.0, 0.0, 0.0, 0.0]
    got = [r.x for r in df.select(lenient_float("v").alias("x")).collect()]
    assert got[2] == 7.0 and got[0] is None and got[9] is None


def test_accounting_replace_first_differs_only_across_lines(spark):
    df = spark.createDataFrame([("(5)",), ("(1)\n(2)",)], "v string")
    first = [r.x for r in df.select(F.regexp_replace("v", r"(?s)^(.*?)\(((?-s:.*))\)", "$1-$2").alias("x")).collect()]
    assert first == ["-5", "-1\n(2)"]


def test_fill_before_filter(spark):
    rows = [("f", 0, "A"), ("f", 1, None), ("f", 2, "Subtotal"), ("f", 3, None), ("f", 4, "B")]
    df = spark.createDataFrame(rows, "file string, row_idx long, k string")
    filled = clean.forward_fill(df, ["k"], "file", "row_idx", block_rows=2)
    kept = clean.drop_summary_rows(filled, "k", ("Subtotal",), "exact").orderBy("row_idx").collect()
    assert [(r.row_idx, r.k) for r in kept] == [(0, "A"), (1, "A"), (4, "B")]


def test_markers(spark):
    df = spark.createDataFrame([(v,) for v in ["Subtotal", "SUBTOTAL", "Total", "count", "x"]], "k string")
    assert {r.k for r in clean.drop_summary_rows(df, "k", ("Subtotal",), "exact").collect()} == {"SUBTOTAL", "Total", "count", "x"}
    assert {r.k for r in clean.drop_summary_rows(df, "k", ("SUBTOTAL", "COUNT", "TOTAL"), "upper").collect()} == {"x"}


def test_forward_fill_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for f in range(4):
        for i in range(rnd.randint(0, 60)):
            rows.append((f"f{f}", i * rnd.randint(1, 3), rnd.choice([None, None, "a", "b", ""]), rnd.choice([None, 1, 2])))
    df = spark.createDataFrame(rows, "file string, row_idx long, a string, b long")
    got = {(r.file, r.row_idx): (r.a, r.b) for r in clean.forward_fill(df, ["a", "b"], "file", "row_idx", block_rows=7).collect()}
    expect = {}
    for f in sorted({r[0] for r in rows}):
        last_a = last_b = None
        for r in sorted([r for r in rows if r[0] == f], key=lambda r: r[1]):
            last_a = r[2] if r[2] is not None else last_a
            last_b = r[3] if r[3] is not None else last_b
            expect[(f, r[1])] = (last_a, last_b)
    assert got == expect


def test_first_with_null(spark):
    df = spark.createDataFrame([("g", 1, None), ("g", 2, 5.0)], "g string, r long, v double")
    assert cons.first_in_group(df, ["g"], "v", "r").first().v is None
    assert cons.first_in_group(df, ["g"], "v", "r", skip_nulls=True).first().v == 5.0


def test_consolidate_captive(spark):
    rows = [("f", 0, "Cap A", "C1", "$100.00", 7.0), ("f", 1, None, "C1", "(50)", None),
            ("f", 2, "Subtotal", None, "999", 1.0), ("f", 3, "Cap B", None, "12%", 3.0)]
    df = spark.createDataFrame(rows, "file string, row_idx long, `Captive Name: Captive Name` string, "
                                     "`Captive Name: Client` string, `Gross Written Premium` string, `Total Available Units` double")
    out = {(r[1], r[2]): r for r in cons.consolidate(df, CAPTIVE_SPEC).collect()}
    assert out[("Cap A", "C1")]["Gross Written Premium"] == 50.0
    assert out[("Cap A", "C1")]["Total Available Units"] == 7.0
    assert out[("Cap B", "")]["Gross Written Premium"] == 0.0


def _charts_df(spark, values):
    return spark.createDataFrame([(f"E{i}", None, float(v), i) for i, v in enumerate(values)],
                                 "cap string, cli string, v double, row_idx long")


def test_stable_top_k(spark):
    df = _charts_df(spark, [5, 5, 4])
    got = [(r.rank, r.label) for r in S.top_entities(df, "v", 2, "cap", "cli").collect()]
    assert got == [(1, "E0"), (2, "E1")]


def test_top_n_others(spark):
    got = S.top_n_others(_charts_df(spark, [10, 5, 3, 2, 1, 1]), "v", 4, "cap").orderBy("rank").collect()
    assert [r.label for r in got] == ["E0", "E1", "E2", "E3", "Others"]
    assert got[-1].value == 2.0
    assert [r.percent for r in got] == [45.45, 22.73, 13.64, 9.09, 9.09]
    neg = S.top_n_others(_charts_df(spark, [10, 5, 3, 2, -1]), "v", 4, "cap").collect()
    assert len(neg) == 4
    assert S.top_n_others(_charts_df(spark, [1, -1]), "v", 4, "cap").count() == 0


def test_share_zero_and_monthly_missing(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "a double, b double")
    got = S.share_of_two(df, "a", "b").collect()
    assert [(r.value, r.percent) for r in got] == [(0.0, 0.0), (0.0, 0.0)]
    wide = spark.createDataFrame([tuple([1.0] * 11)], ", ".join(f"`{c}` double" for c in COMMISSION_COMMISSION[1:]))
    with pytest.raises(ValueError, match="January Commission"):
        S.monthly_totals(wide, COMMISSION_COMMISSION)


def test_entity_key(spark):
    df = spark.createDataFrame([(" A ", " c "), ("A", None), (None, None), (None, "c")], "a string, b string")
    assert [r.k for r in df.select(entity_key("a", "b").alias("k")).collect()] == ["A | c", "A", "", " | c"]


def test_merge(spark):
    left = spark.createDataFrame([("A", "", 1.0, 5.0, 10.0), ("L", "", 2.0, 1.0, 11.0)],
                                 "`Captive Name: Captive Name` string, `Captive Name: Client` string, `POPIC Fee RLIP` double, "
                                 "`Gross Written Premium` double, `Total Available Units` double")
    right = spark.createDataFrame([("A", "", 3.0, 4.0, 20.0, 9.0), ("R", "", 7.0, 1.0, None, 2.0)],
                                  "`Captive Name: Captive Name` string, `Captive Name: Client` string, `POPIC Fee RAP` double, "
                                  "`Gross Written Premium` double, `Total Available Units` double, `Enrolled Units` double")
    out = {r[0]: r.asDict() for r in M.merge_reports(left, right).collect()}
    assert set(out) == {"A", "L", "R"}
    assert out["A"]["Gross Written Premium"] == 9.0 and out["A"]["Total Available Units"] == 10.0
    assert out["R"]["POPIC Fee RLIP"] == 0.0 and out["R"]["Total Available Units"] == 0.0
    assert out["L"]["Enrolled Units"] == 0.0 and out["R"]["Enrolled Units"] == 2.0


def test_user_sort_and_page(spark):
    df = spark.createDataFrame([(0, 3.0), (1, None), (2, float("nan")), (3, 1.0)], "i int, v double")
    asc = [r.i for r in X.user_sort(df, "v", "asc", True, "i").collect()]
    desc = [r.i for r in X.user_sort(df, "v", "desc", True, "i").collect()]
    assert asc == [1, 3, 0, 2] and desc == [0, 3, 1, 2]
    rows = spark.range(30).withColumnRenamed("id", "i")
    page = [r.i for r in X.page_slice(rows, [F.col("i")], 9, 25).collect()]
    assert page == list(range(25, 30))
    info = X.page_info(rows, 9, 25).first()
    assert (info.page_count, info.page_index, info.range_start, info.range_end) == (2, 1, 26, 30)


def test_truncate(spark):
    df = spark.createDataFrame([("abcdefghijklmnopqrstu",), ("short",)], "s string")
    got = [r.t for r in df.select(truncate_middle("s", 20).alias("t")).collect()]
    assert got == ["abcdefgh…nopqrstu", "short"]


def test_sql_text_accounting_equals_column_form(spark):
    from ledgerfold.functions import sqltext as S

    vals = ["($1,234.50)", "$ (12)", "  7 ", "", "12%", "(-5)", "1e3", None, "1_000", "nan", "(1)\n(2)", "$-3.25", "1,2,3"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    a = [r.x for r in df.select(accounting_number("v").alias("x")).collect()]
    b = [r.x for r in df.selectExpr(f"{S.accounting_number('v')} AS x").collect()]
    assert a == b


def test_periods_match_and_period_join(spark):
    one = lambda v: spark.createDataFrame([(1, v)], "pair int, canonical_period string")
    assert M.periods_match(one(None), one(None), ["pair"]).first().ok
    r = M.periods_match(one("November 2025"), one("October 2025"), ["pair"]).first()
    assert not r.ok and r.error.startswith("Cannot merge: RLIP file period is November 2025, RAP file period is October 2025")
    cols = "`Captive Name: Captive Name` string, `Captive Name: Client` string, p string, `POPIC Fee RLIP` double"
    left = spark.createDataFrame([("A", "", "2025-11", 1.0), ("A", "", "2025-12", 2.0)], cols)
    right = spark.createDataFrame([("A", "", "2025-11", 5.0)], cols.replace("RLIP", "RAP"))
    out = {r.p: (r["POPIC Fee RLIP"], r["POPIC Fee RAP"]) for r in M.merge_reports(left, right, period_col="p").collect()}
    assert out == {"2025-11": (1.0, 5.0), "2025-12": (2.0, 0.0)}


def test_page_size_and_distinct_order(spark):
    rows = spark.range(40).withColumnRenamed("id", "i")
    assert X.page_slice(rows, [F.col("i")], 0, 30).count() == 25  # size not offered: keep 25
    df = spark.createDataFrame([(v,) for v in ["b", " A", "a", "", None, "B "]], "v string")
    assert [r.value for r in X.distinct_values(df, "v").collect()] in (["A", "a", "b", "B"], ["a", "A", "b", "B"],
                                                                       ["A", "a", "B", "b"], ["a", "A", "B", "b"])


def test_white_space_of_any_kind_is_stripped(spark):
    texts = ["100\t", "1,234.50\u00a0", "$5 \n", "(7)\u00a0", "\u2003 8 \u3000", "\u00a0"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert [r.x for r in df.select(accounting_number("v").alias("x")).collect()] == [100.0, 1234.5, 5.0, -7.0, 8.0, 0.0]


def test_number_text_of_any_size(spark):
    from ledgerfold.functions.numbers import js_text

    values = [100.0, 0.5, 1e20, 1.5e21, 1e30, 1e-7, 2.5e-5, -1e22, 123456789012.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.t for r in df.select(js_text("v").alias("t")).collect()]
    assert got == ["100", "0.5", "100000000000000000000", "1.5e+21", "1e+30", "1e-7", "0.000025", "-1e+22", "123456789012.25"]
    assert X.search_rows(df, "e+30").count() == 1


def test_date_and_truth_columns_sort_as_text(spark):
    df = spark.sql("SELECT id, date_add(date'2025-01-31', cast(-id as int)) AS d, id % 2 = 0 AS b FROM range(5)")
    assert {r.column_name: r.is_numeric for r in X.profile_numeric(df).collect()} == {"id": True, "d": False, "b": False}
    assert [r.id for r in X.user_sort(df, "d", "asc", order_col="id").collect()] == [4, 3, 2, 1, 0]
    assert [r.id for r in X.sort_rank(df, "b", "desc", order_col="id").orderBy("rank").collect()] == [0, 2, 4, 1, 3]


def test_ranks_and_pages_equal_a_plain_sort(spark):
    import random

    from ledgerfold.operators.ranks import Ranked

    rng = random.Random(1)
    rows = [(i, rng.randrange(20)) for i in range(1000)]
    df = spark.createDataFrame(rows, "i long, v long").repartition(5)
    want = [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    ranked = Ranked(df, [F.col("v").desc(), F.col("i").asc()], partitions=7)
    got = {r.i: r.rank for r in ranked.with_rank().collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == want and sorted(got.values()) == list(range(1, 1001))
    for offset, size in ((0, 10), (333, 100), (990, 25), (5000, 10), (10, 0)):
        assert [r.i for r in ranked.slice(offset, size).collect()] == want[offset:offset + size]
    assert Ranked(df.limit(0), [F.col("i")]).with_rank().count() == 0


def test_no_cached_table_is_left(spark):
    from ledgerfold.plans.queries import QUERIES

    QUERIES["consolidate"](spark, "/root/testdata/sf0.001").count()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_typed_read(spark):
    from ledgerfold.sources.typed import typed_read

    rows = [(0, ["a", "a", None, "d", "e"]), (1, ["1", "1.5", "2025-01-02", "true", "x"]), (2, ["NaN", " 2\u00a0", "", "FALSE"]), (3, ["3", None, "2025-02-28", None, "4"])]
    out = typed_read(spark.createDataFrame(rows, "row_idx long, values array<string>"))
    assert dict(out.dtypes) == {"row_idx": "bigint", "a": "bigint", "a_2": "double", "column_3": "date", "d": "boolean", "e": "string"}
    assert [r.a for r in out.orderBy("row_idx").collect()] == [1, None, 3]


def _shuffled(df):
    """Rows that the last run of ``df``'s plan moved through shuffles, and the kinds of its nodes."""
    rows, kinds = 0, []

    def walk(node):
        nonlocal rows
        name = node.getClass().getSimpleName()
        kinds.append(name)
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "ShuffleExchangeExec":
            rows += node.metrics().apply("shuffleRecordsWritten").value()
        if name == "ReusedExchangeExec":
            return
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return rows, kinds


def _wide_rows(files, lines):
    rnd = random.Random(3)
    return [(f, i, rnd.choice([None, None, "A", "b", "Subtotal"]), rnd.choice([None, "C1", "C2"]), rnd.choice(["$1.50", "(2)", None]), rnd.choice([None, 3.0, float(i)]))
            for f in files for i in range(lines)]


WIDE = "file string, row_idx long, `Captive Name: Captive Name` string, `Captive Name: Client` string, `Gross Written Premium` string, `Total Available Units` double"


@pytest.mark.parametrize("block_rows", [7, 40, 1000])
def test_consolidate_of_files_in_one_and_in_several_blocks(spark, block_rows):
    """Groups within blocks, put together for files of several, are those of plain loops."""
    rows = _wide_rows(["f1", "f2", "f3"], 60) + _wide_rows(["short"], 5) + [(None, i, "A", "C1", "4", float(i)) for i in range(3)]
    want, last = {}, {}
    for f, i, cap, client, gwp, units in rows:
        cap = last[f] = last.get(f) if cap is None else cap
        if cap in (None, "Subtotal"):
            continue
        money = {"$1.50": 1.5, "(2)": -2.0, "4": 4.0, None: 0.0}[gwp]
        key = (f, cap, client or "")
        want[key] = (want[key][0] + money, want[key][1]) if key in want else (money, 0.0 if units is None else units)
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), WIDE).repartition(3)
    got = cons.consolidate(df, CAPTIVE_SPEC, block_rows=block_rows).collect()
    assert len(got) == len(want)
    assert {(r[0], r[1], r[2]): (r["Gross Written Premium"], r["Total Available Units"]) for r in got} == want


def test_rows_are_shuffled_once(spark):
    df = spark.createDataFrame(_wide_rows([f"f{i}" for i in range(40)], 50), WIDE)
    tails = 40 * df.rdd.getNumPartitions()
    out = cons.consolidate(df, CAPTIVE_SPEC)
    groups = len(out.collect())
    # The rows themselves, and for the fill at most a row a file and task, then a row a file.
    assert groups > 200 and 2000 <= _shuffled(out)[0] <= 2000 + tails + 40
    # Files of several blocks: their groups too, from the rows' one shuffle.
    out = cons.consolidate(df, CAPTIVE_SPEC, block_rows=20)
    assert len(out.collect()) == groups
    moved, kinds = _shuffled(out)
    assert moved < 4000 and "ReusedExchangeExec" in kinds


def test_three_key_rows_are_written_before_the_fill(spark, sf_small):
    """The numbering and the joins are not done again, nor their shuffles kept, beside the wide rows' shuffle."""
    from ledgerfold.plans.queries import _supplier_rows

    rows = _supplier_rows(spark, sf_small)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and not any("lineitem" in f for f in rows.inputFiles())
