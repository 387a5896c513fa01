"""Period parsing: the reference's period tests plus file-name and month-text edges."""

from pyspark.sql import functions as F

from ledgerfold.functions import periods as P


def _periods(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    out = df.select(fn(F.col("v")).alias("p")).collect()
    return [None if r.p is None else (r.p.year, r.p.month) for r in out]


def test_filename(spark):
    names = ["RLIP Financial November 2025.xlsx", "Report_August 2024.xlsx", "Summary Nov 2025.csv",
             "data_2025-11.xlsx", None, "", "random_file.xlsx", "Report_Nov 2025", "x_2025_11_30", "May2025", "x may 50"]
    assert _periods(spark, P.period_from_filename, names) == [
        (2025, 11), (2024, 8), (2025, 11), (2025, 11), None, None, None, None, None, (2025, 5), (1950, 5)]


def test_filename_staged_equals_single_expression(spark):
    names = ["RLIP Financial November 2025.xlsx", "Summary Nov 25.csv", "data_2025-11.xlsx", "x may 50", "junk"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    a = [r.p for r in df.select(P.period_from_filename("n").alias("p")).collect()]
    b = [r.p for r in P.with_filename_period(df, "n", "p").select("p").collect()]
    assert a == b


def test_title(spark):
    assert _periods(spark, P.period_from_title_text, ["November 2025", "Report period: 2025/09", "Month: November"]) == [
        (2025, 11), (2025, 9), None]


def test_month_number(spark):
    df = spark.createDataFrame([(v,) for v in ["", "ma", "11", "03", "x", "June", "12.0"]], "v string")
    got = [r.m for r in df.select(P.month_number("v").alias("m")).collect()]
    assert got == [None, 3, 11, 3, 0, 6, 12]


def test_format_and_notes(spark):
    df = spark.createDataFrame(
        [((2025, 11), (2025, 11), (2025, 11)), ((2025, 11), (2024, 8), None), ((2025, 11), None, (2025, 9)),
         (None, (2024, 8), (2025, 9)), ((2025, 13), None, None)],
        "t struct<year:int,month:int>, f struct<year:int,month:int>, h struct<year:int,month:int>")
    out = df.select(P.format_period("t").alias("ft"), P.discrepancy_notes("t", "f", "h").alias("n")).collect()
    assert out[0].ft == "November 2025" and out[0].n == []
    assert out[1].n == ["Filename suggests August 2024; table period is November 2025."]
    assert out[2].n == ["Header suggests September 2025; table period is November 2025."]
    assert out[3].n == []
    assert out[4].ft == "2025-13"


def test_sql_text_forms_equal_column_forms(spark):
    vals = ["", "ma", "11", "03", "x", "June", "12.0", None, "November 2025", "Report period: 2025/09", " may   2024 "]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    a = [r.m for r in df.select(P.month_number("v").alias("m")).collect()]
    b = [r.m for r in P.with_month_number(df, "v", "m").select("m").collect()]
    assert a == b
    a = [r.p for r in df.select(P.period_from_title_text("v").alias("p")).collect()]
    b = [r.p for r in P.with_title_period(df, "v", "p").select("p").collect()]
    assert a == b


def test_sql_text_notes_equal_column_form(spark):
    from ledgerfold.functions import sqltext as S

    df = spark.createDataFrame(
        [((2025, 11), (2025, 11), (2025, 11)), ((2025, 11), (2024, 8), None), ((2025, 11), None, (2025, 9)),
         (None, (2024, 8), (2025, 9)), ((2025, 13), (2025, 1), (2024, 1))],
        "t struct<year:int,month:int>, f struct<year:int,month:int>, h struct<year:int,month:int>")
    a = df.select(P.format_period("t").alias("x"), P.discrepancy_notes("t", "f", "h").alias("n")).collect()
    b = df.selectExpr(f"{S.format_period('t')} AS x", f"{S.discrepancy_notes('t', 'f', 'h')} AS n").collect()
    assert a == b
