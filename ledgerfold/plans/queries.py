"""Registered queries over the supplied tables, each with an SQL oracle.

Every query reads whole tables (no id subsets, no row caps) and returns plain,
aliased column names; money is rounded to cents on both sides because sums of
doubles in a different order differ in the last bits.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators import clean, consolidate as cons, summaries
from ledgerfold.plans import testdata as td
from ledgerfold.spec import CAPTIVE_SPEC, COMMISSION_COMMISSION, COMMISSION_PNL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def snake(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9]", "_", name.lower())).strip("_")


def _snake_all(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake(c) for c in df.columns])


def _round_doubles(df: DataFrame, digits: int = 2) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ consolidate

CONSOLIDATE_SQL = "WITH " + td.CAPTIVE_ROWS_SQL + f""",
filled AS (
  SELECT *, {td.forward_fill_sql('"Captive Name: Captive Name"', 'file', 'row_idx')} AS captive_f
  FROM captive_rows),
kept AS (
  SELECT file, row_idx, captive_f AS captive,
    coalesce("Captive Name: Client", '') AS client,
    {td.accounting_parse_sql('"Gross Written Premium"')} AS gwp,
    coalesce("Taxes", 0.0) AS taxes,
    {td.accounting_parse_sql('"POPIC Fee RLIP"')} AS fee,
    coalesce("Total Available Units", 0.0) AS units
  FROM filled
  WHERE captive_f IS NOT NULL AND captive_f <> 'Subtotal')
SELECT file, captive AS captive_name_captive_name, client AS captive_name_client,
  round(sum(gwp), 2) AS gross_written_premium, round(sum(taxes), 2) AS taxes,
  round(sum(fee), 2) AS popic_fee_rlip, round(arg_min_null(units, row_idx), 2) AS total_available_units
FROM kept GROUP BY file, captive, client"""


@register("consolidate", CONSOLIDATE_SQL)
def q_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = td.captive_rows(spark, sf_dir)
    out = cons.consolidate(rows, CAPTIVE_SPEC)
    return _round_doubles(_snake_all(out))


# ------------------------------------------------------------------ top entities

TOP_ENTITIES_SQL = "WITH " + td.SALES_ROWS_SQL + """,
ent AS (
  SELECT CASE WHEN trim(c_mktsegment) <> '' THEN trim(n_name) || ' | ' || trim(c_mktsegment) ELSE trim(n_name) END AS label,
    sum(l_extendedprice) AS value, min(row_idx) AS first_row
  FROM sales_rows GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY value DESC, first_row) AS INTEGER) AS rank, label, round(value, 2) AS value
FROM ent ORDER BY value DESC, first_row LIMIT 7"""


@register("top_entities", TOP_ENTITIES_SQL)
def q_top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = td.sales_rows(spark, sf_dir)
    out = summaries.top_entities(rows, "l_extendedprice", 7, "n_name", "c_mktsegment", "row_idx")
    return _round_doubles(out)


# ------------------------------------------------------------------ typed read, NaN

NAN_EVENTS_SQL = """events_nan AS (
  SELECT event_id, user_id, event_type,
    CASE WHEN event_id % 50 = 0 THEN 'NaN'::DOUBLE ELSE value END AS value, props
  FROM events)"""


def _events_nan(spark, sf_dir):
    ev = td.table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "user_id", "event_type",
        F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        "props",
    )


@register("raw_scan", "WITH " + NAN_EVENTS_SQL + """
SELECT event_id, user_id, event_type, CASE WHEN isnan(value) THEN NULL ELSE value END AS value, props,
  (value IS NULL OR isnan(value)) AS value_is_null
FROM events_nan""")
def q_raw_scan(spark, sf_dir):
    return clean.nan_to_null(_events_nan(spark, sf_dir)).withColumn("value_is_null", F.col("value").isNull())


@register("nan_to_null", "WITH " + NAN_EVENTS_SQL + """
SELECT event_id, isnan(value) AS was_nan, CASE WHEN isnan(value) THEN NULL ELSE value END AS value,
  (value IS NULL OR isnan(value)) AS value_is_null
FROM events_nan""")
def q_nan_to_null(spark, sf_dir):
    from ledgerfold.functions.numbers import nan_to_null

    ev = _events_nan(spark, sf_dir)
    out = ev.select("event_id", F.isnan("value").alias("was_nan"), nan_to_null("value").alias("value"))
    return out.withColumn("value_is_null", F.col("value").isNull())


# ------------------------------------------------------------------ forward fill

FILL_BLOCK_ROWS = 256  # small blocks so the cross-block carry path is exercised


def _events_blank(spark, sf_dir, markers: bool = False):
    ev = td.table(spark, sf_dir, "events")
    eid = F.col("event_id")
    etype = F.when(eid % 3 != 0, F.lit(None).cast("string")).otherwise(F.col("event_type"))
    if markers:
        mk = F.when((eid / 17).cast("long") % 3 == 0, "SubTotal").when((eid / 17).cast("long") % 3 == 1, "count").otherwise("TOTAL")
        etype = F.when(eid % 17 == 0, mk).otherwise(etype)
    return ev.select(
        eid,
        F.expr("event_id div 1000").alias("file"),
        etype.alias("event_type"),
        F.when(eid % 5 != 0, F.lit(None).cast("long")).otherwise(F.col("user_id")).alias("user_id"),
    )


EVENTS_BLANK_SQL = """ev AS (
  SELECT event_id, event_id // 1000 AS file,
    CASE WHEN event_id % 3 <> 0 THEN NULL ELSE event_type END AS event_type,
    CASE WHEN event_id % 5 <> 0 THEN NULL ELSE user_id END AS user_id
  FROM events)"""

EVENTS_MARKED_SQL = """ev AS (
  SELECT event_id, event_id // 1000 AS file,
    CASE WHEN event_id % 17 = 0 THEN (CASE (event_id // 17) % 3 WHEN 0 THEN 'SubTotal' WHEN 1 THEN 'count' ELSE 'TOTAL' END)
         WHEN event_id % 3 <> 0 THEN NULL ELSE event_type END AS event_type,
    CASE WHEN event_id % 5 <> 0 THEN NULL ELSE user_id END AS user_id
  FROM events)"""


@register("forward_fill", "WITH " + EVENTS_BLANK_SQL + f"""
SELECT event_id, file, {td.forward_fill_sql('event_type', 'file', 'event_id')} AS event_type FROM ev""")
def q_forward_fill(spark, sf_dir):
    ev = _events_blank(spark, sf_dir).select("event_id", "file", "event_type")
    return clean.forward_fill(ev, ["event_type"], "file", "event_id", block_rows=FILL_BLOCK_ROWS)


@register("forward_fill_multi", "WITH " + EVENTS_BLANK_SQL + f"""
SELECT event_id, file, {td.forward_fill_sql('event_type', 'file', 'event_id')} AS event_type,
  {td.forward_fill_sql('user_id', 'file', 'event_id')} AS user_id FROM ev""")
def q_forward_fill_multi(spark, sf_dir):
    ev = _events_blank(spark, sf_dir)
    return clean.forward_fill(ev, ["event_type", "user_id"], "file", "event_id", block_rows=FILL_BLOCK_ROWS)


@register("drop_summary", "WITH " + EVENTS_MARKED_SQL + f""",
f AS (SELECT event_id, file, {td.forward_fill_sql('event_type', 'file', 'event_id')} AS event_type,
  {td.forward_fill_sql('user_id', 'file', 'event_id')} AS user_id FROM ev)
SELECT * FROM f WHERE event_type IS NOT NULL AND upper(event_type) NOT IN ('SUBTOTAL', 'COUNT', 'TOTAL')""")
def q_drop_summary(spark, sf_dir):
    ev = _events_blank(spark, sf_dir, markers=True)
    filled = clean.forward_fill(ev, ["event_type", "user_id"], "file", "event_id", block_rows=FILL_BLOCK_ROWS)
    return clean.drop_summary_rows(filled, "event_type", ("SUBTOTAL", "COUNT", "TOTAL"), "upper")


@register("drop_subtotal", "WITH " + EVENTS_MARKED_SQL + f""",
f AS (SELECT event_id, file, {td.forward_fill_sql('event_type', 'file', 'event_id')} AS event_type FROM ev)
SELECT * FROM f WHERE event_type IS NOT NULL AND event_type <> 'SubTotal'""")
def q_drop_subtotal(spark, sf_dir):
    ev = _events_blank(spark, sf_dir, markers=True).select("event_id", "file", "event_type")
    filled = clean.forward_fill(ev, ["event_type"], "file", "event_id", block_rows=FILL_BLOCK_ROWS)
    return clean.drop_summary_rows(filled, "event_type", ("SubTotal",), "exact")


# ------------------------------------------------------------------ numbers


# Every seventh text ends in white space that is no blank: tab, no-break space, line feed.
ODD_SPACE_SQL = "({x} || CASE {k} % 28 WHEN 0 THEN chr(9) WHEN 7 THEN chr(160) WHEN 14 THEN chr(10) WHEN 21 THEN chr(8195) ELSE '' END)"


def _odd_space(text, k):
    k = k % 28
    return F.concat(text, F.when(k == 0, "\t").when(k == 7, "\u00a0").when(k == 14, "\n").when(k == 21, "\u2003").otherwise(""))


@register("accounting_parse", "WITH " + td.LINEITEM_ROWS_SQL + f""",
t AS (SELECT row_idx, {ODD_SPACE_SQL.format(x=td.money_text_sql('l_extendedprice', 'row_idx % 5'), k='row_idx')} AS amount_text FROM lineitem_rows)
SELECT row_idx, amount_text, {td.accounting_parse_sql('amount_text')} AS amount FROM t""")
def q_accounting_parse(spark, sf_dir):
    from ledgerfold.functions.numbers import accounting_number

    li = td.lineitem_rows(spark, sf_dir)
    t = li.select("row_idx", _odd_space(td.money_text(F.col("l_extendedprice"), F.col("row_idx") % 5), F.col("row_idx")).alias("amount_text"))
    return t.select("row_idx", "amount_text", accounting_number("amount_text").alias("amount"))


LENIENT_TEXT_SQL = """CASE row_idx % 6
  WHEN 0 THEN CAST(l_quantity AS VARCHAR)
  WHEN 1 THEN '  ' || CAST(l_extendedprice AS VARCHAR) || ' '
  WHEN 2 THEN format('{:,.2f}', l_extendedprice)
  WHEN 3 THEN 'abc'
  WHEN 4 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'e1'
  ELSE 'nan' END"""


@register("lenient_float", "WITH " + td.LINEITEM_ROWS_SQL + f""",
t AS (SELECT row_idx, {ODD_SPACE_SQL.format(x='(' + LENIENT_TEXT_SQL + ')', k='row_idx')} AS txt FROM lineitem_rows)
SELECT row_idx, txt, {td.lenient_float_sql('txt')} AS value FROM t""")
def q_lenient_float(spark, sf_dir):
    from ledgerfold.functions.numbers import lenient_float

    li = td.lineitem_rows(spark, sf_dir)
    k = F.col("row_idx") % 6
    txt = (
        F.when(k == 0, F.col("l_quantity").cast("string"))
        .when(k == 1, F.concat(F.lit("  "), F.col("l_extendedprice").cast("string"), F.lit(" ")))
        .when(k == 2, F.format_number("l_extendedprice", 2))
        .when(k == 3, F.lit("abc"))
        .when(k == 4, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("e1")))
        .otherwise(F.lit("nan"))
    )
    t = li.select("row_idx", _odd_space(txt, F.col("row_idx")).alias("txt"))
    return t.select("row_idx", "txt", lenient_float("txt").alias("value"))


# ------------------------------------------------------------------ first value


@register("first_in_group", """
SELECT o_custkey, arg_min_null(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END, o_orderkey) AS first_priority,
  count(*) AS n_orders
FROM orders GROUP BY o_custkey""")
def q_first_in_group(spark, sf_dir):
    o = td.table(spark, sf_dir, "orders")
    o = o.select(
        "o_custkey", "o_orderkey",
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("p"),
    )
    return o.groupBy("o_custkey").agg(
        F.min_by("p", "o_orderkey").alias("first_priority"), F.count(F.lit(1)).alias("n_orders")
    )


# ------------------------------------------------------------------ entity key

ENTITY_SRC_SQL = """src AS (
  SELECT c_custkey,
    CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN ' ' || n_name || ' ' ELSE n_name END AS cap,
    CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS cli
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@register("entity_key", "WITH " + ENTITY_SRC_SQL + """
SELECT c_custkey, CASE WHEN trim(coalesce(cli, '')) <> '' THEN trim(coalesce(cap, '')) || ' | ' || trim(coalesce(cli, ''))
  ELSE trim(coalesce(cap, '')) END AS entity FROM src""")
def q_entity_key(spark, sf_dir):
    from ledgerfold.functions.text import entity_key

    c = td.table(spark, sf_dir, "customer")
    n = F.broadcast(td.table(spark, sf_dir, "nation"))
    k = F.col("c_custkey")
    src = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        k,
        F.when(k % 9 == 0, F.lit(None).cast("string"))
        .when(k % 4 == 0, F.concat(F.lit(" "), F.col("n_name"), F.lit(" ")))
        .otherwise(F.col("n_name")).alias("cap"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 7 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("cli"),
    )
    return src.select(k, entity_key("cap", "cli").alias("entity"))


# ------------------------------------------------------------------ charts

ENTITY_LABEL_SQL = "CASE WHEN trim(c_mktsegment) <> '' THEN trim(n_name) || ' | ' || trim(c_mktsegment) ELSE trim(n_name) END"


@register("top_entities_first", "WITH " + td.SALES_ROWS_SQL + f""",
v AS (SELECT {ENTITY_LABEL_SQL} AS label, CASE WHEN row_idx % 4 = 1 THEN NULL ELSE l_quantity END AS q, row_idx FROM sales_rows),
ent AS (SELECT label, arg_min(q, row_idx) AS value, min(row_idx) AS first_row FROM v WHERE label <> '' AND q IS NOT NULL GROUP BY label)
SELECT CAST(row_number() OVER (ORDER BY value DESC, first_row) AS INTEGER) AS rank, label, value
FROM ent ORDER BY value DESC, first_row LIMIT 5""")
def q_top_entities_first(spark, sf_dir):
    rows = td.sales_rows(spark, sf_dir).withColumn(
        "units", F.when(F.col("row_idx") % 4 == 1, F.lit(None).cast("double")).otherwise(F.col("l_quantity"))
    )
    return summaries.top_entities(rows, "units", 5, "n_name", "c_mktsegment", "row_idx", take_first=True)


ORDERS_NATION_SQL = """onat AS (
  SELECT o.*, n_name, c_mktsegment, c_nationkey FROM orders o JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey)"""


def _orders_nation(spark, sf_dir):
    o = td.table(spark, sf_dir, "orders")
    c = td.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_name")
    n = F.broadcast(td.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))


@register("top_n_others", "WITH " + ORDERS_NATION_SQL + """,
ent AS (SELECT trim(n_name) AS label, sum(o_totalprice) AS value, min(o_orderkey) AS first_row
  FROM onat WHERE trim(n_name) <> '' GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY value DESC, first_row) AS rn FROM ent),
tot AS (SELECT sum(value) AS total, sum(value) FILTER (WHERE rn > 4) AS rest FROM ranked),
slices AS (
  SELECT CAST(rn AS INTEGER) AS rank, label, value FROM ranked WHERE rn <= 4
  UNION ALL SELECT 5, 'Others', rest FROM tot WHERE rest > 0)
SELECT rank, label, round(value, 2) AS value, round(100.0 * value / total, 2) AS percent
FROM slices, tot WHERE total <> 0""")
def q_top_n_others(spark, sf_dir):
    rows = _orders_nation(spark, sf_dir)
    out = summaries.top_n_others(rows, "o_totalprice", 4, "n_name", None, "o_orderkey")
    return out.select("rank", "label", F.round("value", 2).alias("value"), "percent")


@register("share_of_two", """
WITH t AS (SELECT coalesce(sum(l_tax), 0.0) AS a, coalesce(sum(l_discount), 0.0) AS b FROM lineitem)
SELECT 1 AS rank, 'l_tax' AS label, round(a, 2) AS value,
  CASE WHEN a + b = 0 THEN 0.0 ELSE round(100.0 * a / (a + b), 2) END AS percent FROM t
UNION ALL
SELECT 2, 'l_discount', round(b, 2), CASE WHEN a + b = 0 THEN 0.0 ELSE round(100.0 * b / (a + b), 2) END FROM t""")
def q_share_of_two(spark, sf_dir):
    li = td.table(spark, sf_dir, "lineitem")
    out = summaries.share_of_two(li, "l_tax", "l_discount")
    return out.select("rank", "label", F.round("value", 2).alias("value"), "percent")


@register("monthly_totals", """
WITH t AS (SELECT month(o_orderdate) AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1),
months AS (SELECT CAST(range + 1 AS INTEGER) AS month_idx FROM range(12))
SELECT month_idx, monthname(make_date(2000, month_idx, 1)) AS month, round(coalesce(v, 0.0), 2) AS value
FROM months LEFT JOIN t ON t.m = months.month_idx""")
def q_monthly_totals(spark, sf_dir):
    from ledgerfold.spec import COMMISSION_COMMISSION

    o = td.table(spark, sf_dir, "orders")
    wide = o.select(
        *[F.when(F.month("o_orderdate") == i, F.col("o_totalprice")).alias(c) for i, c in enumerate(COMMISSION_COMMISSION, 1)]
    )
    out = summaries.monthly_totals(wide, COMMISSION_COMMISSION)
    return out.select("month_idx", "month", F.round("value", 2).alias("value"))


# ------------------------------------------------------------------ merge

MERGE_SQL = "WITH " + td.SALES_ROWS_SQL + """,
l AS (SELECT n_name AS captive, c_mktsegment AS client, sum(l_extendedprice) AS rlip, sum(l_tax) AS gwp,
        arg_min_null(l_quantity, row_idx) AS units
      FROM sales_rows WHERE l_returnflag = 'R' AND n_regionkey <> 0 GROUP BY 1, 2),
r AS (SELECT n_name AS captive, c_mktsegment AS client, sum(l_extendedprice) AS rap, sum(l_tax) AS gwp,
        arg_min_null(l_quantity, row_idx) AS units, sum(l_quantity) AS enrolled
      FROM sales_rows WHERE l_returnflag = 'A' AND n_regionkey <> 1 GROUP BY 1, 2)
SELECT captive AS captive_name_captive_name, client AS captive_name_client,
  round(coalesce(l.rlip, 0.0), 2) AS popic_fee_rlip,
  round(coalesce(l.gwp, 0.0) + coalesce(r.gwp, 0.0), 2) AS gross_written_premium,
  round(coalesce(l.units, r.units, 0.0), 2) AS total_available_units,
  round(coalesce(r.rap, 0.0), 2) AS popic_fee_rap,
  round(coalesce(r.enrolled, 0.0), 2) AS enrolled_units
FROM l FULL JOIN r USING (captive, client)"""


def _half_report(rows: DataFrame, flag: str, skip_region: int, measures: dict) -> DataFrame:
    """One half-report: lines with one return flag, customers outside one region
    (so each side has keys the other lacks)."""
    from ledgerfold.spec import CAPTIVE_CLIENT, CAPTIVE_KEY

    src = rows.filter((F.col("l_returnflag") == flag) & (F.col("n_regionkey") != skip_region)).select(
        F.lit("all").alias("file"), "row_idx",
        F.col("n_name").alias(CAPTIVE_KEY), F.col("c_mktsegment").alias(CAPTIVE_CLIENT),
        *[F.col(src).alias(dst) for dst, src in measures.items()],
    )
    cleaned = clean.clean_measures(src, CAPTIVE_SPEC)
    return cons.group_rows(cleaned, CAPTIVE_SPEC, file_col="file", per_file=False, sort=False)


@register("merge_reports", MERGE_SQL)
def q_merge_reports(spark, sf_dir):
    from ledgerfold.operators.merge import merge_reports

    rows = td.sales_rows(spark, sf_dir)
    left = _half_report(rows, "R", 0, {"POPIC Fee RLIP": "l_extendedprice", "Gross Written Premium": "l_tax",
                                        "Total Available Units": "l_quantity"})
    right = _half_report(rows, "A", 1, {"POPIC Fee RAP": "l_extendedprice", "Gross Written Premium": "l_tax",
                                         "Total Available Units": "l_quantity", "Enrolled Units": "l_quantity"})
    return _round_doubles(_snake_all(merge_reports(left, right)))


# ------------------------------------------------------------------ periods


def _orders_dates(spark, sf_dir):
    o = td.table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderdate",
        F.date_format("o_orderdate", "MMMM").alias("mname"),
        F.date_format("o_orderdate", "MMM").alias("mshort"),
        F.year("o_orderdate").alias("yy"),
        F.month("o_orderdate").alias("mm"),
    )


ORDERS_DATES_SQL = """od AS (
  SELECT o_orderkey, o_custkey, o_orderdate, monthname(o_orderdate) AS mname, strftime(o_orderdate, '%b') AS mshort,
    year(o_orderdate) AS yy, month(o_orderdate) AS mm
  FROM orders)"""

FILENAME_SQL = """CASE o_orderkey % 8
  WHEN 0 THEN 'Report_' || mname || ' ' || CAST(yy AS VARCHAR) || '.xlsx'
  WHEN 1 THEN 'Summary ' || mshort || ' ' || right(CAST(yy AS VARCHAR), 2) || '.csv'
  WHEN 2 THEN 'data_' || CAST(yy + 25 AS VARCHAR) || '-' || CAST(mm AS VARCHAR) || '.xlsx'
  WHEN 3 THEN 'Report_' || mshort || ' ' || CAST(yy AS VARCHAR) || '.xlsx'
  WHEN 4 THEN 'x_' || CAST(yy + 25 AS VARCHAR) || '_' || CAST(mm AS VARCHAR) || '_30'
  WHEN 5 THEN upper(mname) || CAST(yy AS VARCHAR)
  WHEN 6 THEN 'RLIP ' || lower(mname) || ' ' || right(CAST(yy AS VARCHAR), 2) || '.v2.xlsx'
  ELSE 'random_file.xlsx' END"""


def _filename(d: DataFrame):
    k = F.col("o_orderkey") % 8
    y = F.col("yy").cast("string")
    y2 = F.substring(y, -2, 2)
    return (
        F.when(k == 0, F.concat(F.lit("Report_"), "mname", F.lit(" "), y, F.lit(".xlsx")))
        .when(k == 1, F.concat(F.lit("Summary "), "mshort", F.lit(" "), y2, F.lit(".csv")))
        .when(k == 2, F.concat(F.lit("data_"), (F.col("yy") + 25).cast("string"), F.lit("-"), F.col("mm").cast("string"), F.lit(".xlsx")))
        .when(k == 3, F.concat(F.lit("Report_"), "mshort", F.lit(" "), y, F.lit(".xlsx")))
        .when(k == 4, F.concat(F.lit("x_"), (F.col("yy") + 25).cast("string"), F.lit("_"), F.col("mm").cast("string"), F.lit("_30")))
        .when(k == 5, F.concat(F.upper("mname"), y))
        .when(k == 6, F.concat(F.lit("RLIP "), F.lower("mname"), F.lit(" "), y2, F.lit(".v2.xlsx")))
        .otherwise(F.lit("random_file.xlsx"))
    )


@register("period_from_name", "WITH " + ORDERS_DATES_SQL + f""",
f AS (SELECT o_orderkey, {FILENAME_SQL} AS filename FROM od),
p AS (SELECT o_orderkey, filename, {td.period_from_filename_sql('filename')} AS per FROM f)
SELECT o_orderkey, filename, per.year AS year, per.month AS month FROM p""")
def q_period_from_name(spark, sf_dir):
    from ledgerfold.functions.periods import with_filename_period

    d = _orders_dates(spark, sf_dir)
    f = d.select("o_orderkey", _filename(d).alias("filename"))
    p = with_filename_period(f, "filename", "per")
    return p.select("o_orderkey", "filename", F.col("per.year").alias("year"), F.col("per.month").alias("month"))


TITLE_SQL = """CASE o_orderkey % 5
  WHEN 0 THEN mname || ' ' || CAST(yy AS VARCHAR)
  WHEN 1 THEN 'Report period: ' || CAST(yy + 25 AS VARCHAR) || '/' || CAST(mm AS VARCHAR)
  WHEN 2 THEN 'Generated ' || mname || ' ' || CAST(yy AS VARCHAR)
  WHEN 3 THEN ' ' || upper(mname) || '  ' || CAST(yy AS VARCHAR)
  ELSE 'Printed ' || CAST(yy AS VARCHAR) || '-' || CAST(mm AS VARCHAR) END"""


def _title_text(d: DataFrame):
    k = F.col("o_orderkey") % 5
    y = F.col("yy").cast("string")
    return (
        F.when(k == 0, F.concat("mname", F.lit(" "), y))
        .when(k == 1, F.concat(F.lit("Report period: "), (F.col("yy") + 25).cast("string"), F.lit("/"), F.col("mm").cast("string")))
        .when(k == 2, F.concat(F.lit("Generated "), "mname", F.lit(" "), y))
        .when(k == 3, F.concat(F.lit(" "), F.upper("mname"), F.lit("  "), y))
        .otherwise(F.concat(F.lit("Printed "), y, F.lit("-"), F.col("mm").cast("string")))
    )


@register("period_from_title", "WITH " + ORDERS_DATES_SQL + f""",
c AS (SELECT o_custkey AS file, o_orderkey AS row_idx, 0 AS col_idx, {TITLE_SQL} AS value FROM od),
p AS (SELECT file, row_idx, col_idx, {td.period_from_title_sql('value')} AS per FROM c)
SELECT file, arg_min(per, (row_idx, col_idx)).year AS year, arg_min(per, (row_idx, col_idx)).month AS month
FROM p WHERE per IS NOT NULL GROUP BY file""")
def q_period_from_title(spark, sf_dir):
    from ledgerfold.operators.periods import period_from_title

    d = _orders_dates(spark, sf_dir)
    cells = d.select(
        F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("row_idx"), F.lit(0).alias("col_idx"),
        _title_text(d).alias("value"),
    )
    p = period_from_title(cells)
    return p.select("file", F.col("period_from_header.year").alias("year"), F.col("period_from_header.month").alias("month"))


MONTH_TEXT_SQL = """CASE o_orderkey % 9
  WHEN 0 THEN mname WHEN 1 THEN mshort WHEN 2 THEN lower(substr(mname, 1, 2))
  WHEN 3 THEN CAST(mm AS VARCHAR) WHEN 4 THEN lpad(CAST(mm AS VARCHAR), 2, '0') WHEN 5 THEN ''
  WHEN 6 THEN 'x' WHEN 7 THEN upper(mname) ELSE CAST(mm AS VARCHAR) || '.0' END"""


def _month_text(d: DataFrame):
    k = F.col("o_orderkey") % 9
    m = F.col("mm").cast("string")
    return (
        F.when(k == 0, F.col("mname")).when(k == 1, F.col("mshort")).when(k == 2, F.lower(F.substring("mname", 1, 2)))
        .when(k == 3, m).when(k == 4, F.lpad(m, 2, "0")).when(k == 5, F.lit(""))
        .when(k == 6, F.lit("x")).when(k == 7, F.upper("mname")).otherwise(F.concat(m, F.lit(".0")))
    )


@register("month_number", "WITH " + ORDERS_DATES_SQL + f"""
SELECT o_orderkey, {MONTH_TEXT_SQL} AS month_text, {td.month_number_sql(MONTH_TEXT_SQL)} AS month_num FROM od""")
def q_month_number(spark, sf_dir):
    from ledgerfold.functions.periods import with_month_number

    d = _orders_dates(spark, sf_dir)
    t = d.select("o_orderkey", _month_text(d).alias("month_text"))
    return with_month_number(t, "month_text", "month_num")


YEAR_TEXT_SQL = """CASE o_orderkey % 4 WHEN 0 THEN CAST(yy AS VARCHAR) WHEN 1 THEN NULL
  WHEN 2 THEN CAST(yy AS VARCHAR) || '.0' ELSE '  ' || CAST(yy AS VARCHAR) || ' ' END"""


def _year_text(d: DataFrame):
    k = F.col("o_orderkey") % 4
    y = F.col("yy").cast("string")
    return (
        F.when(k == 0, y).when(k == 1, F.lit(None).cast("string")).when(k == 2, F.concat(y, F.lit(".0")))
        .otherwise(F.concat(F.lit("  "), y, F.lit(" ")))
    )


@register("period_from_table", "WITH " + ORDERS_DATES_SQL + f""",
t AS (SELECT o_custkey AS file, o_orderkey AS row_idx, {td.month_number_sql(MONTH_TEXT_SQL)} AS m,
        {td.year_number_sql(YEAR_TEXT_SQL)} AS y FROM od),
v AS (SELECT * FROM t WHERE m BETWEEN 1 AND 12 AND y BETWEEN 1900 AND 2100)
SELECT file, arg_min(y, row_idx) AS year, arg_min(m, row_idx) AS month FROM v GROUP BY file""")
def q_period_from_table(spark, sf_dir):
    from ledgerfold.operators.periods import period_from_table

    d = _orders_dates(spark, sf_dir)
    t = d.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("row_idx"),
                 _month_text(d).alias("Month"), _year_text(d).alias("Year"))
    p = period_from_table(t, "Month", "Year")
    return p.select("file", F.col("canonical_period.year").alias("year"), F.col("canonical_period.month").alias("month"))


@register("period_from_year", "WITH " + ORDERS_DATES_SQL + f""",
t AS (SELECT o_custkey AS file, o_orderkey AS row_idx, {td.year_number_sql(YEAR_TEXT_SQL)} AS y FROM od)
SELECT file, arg_min(y, row_idx) AS year, 1 AS month FROM t WHERE y BETWEEN 1900 AND 2100 GROUP BY file""")
def q_period_from_year(spark, sf_dir):
    from ledgerfold.operators.periods import period_from_year

    d = _orders_dates(spark, sf_dir)
    t = d.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("row_idx"), _year_text(d).alias("Year"))
    p = period_from_year(t, "Year")
    return p.select("file", F.col("canonical_period.year").alias("year"), F.col("canonical_period.month").alias("month"))


@register("format_period", "WITH " + ORDERS_DATES_SQL + f"""
SELECT o_orderkey, CAST(yy AS INTEGER) AS year, CAST(o_orderkey % 14 AS INTEGER) AS month,
  {td.format_period_sql('yy', 'CAST(o_orderkey % 14 AS INTEGER)')} AS period_text FROM od""")
def q_format_period(spark, sf_dir):
    from ledgerfold.functions.periods import format_period, period

    d = _orders_dates(spark, sf_dir)
    t = d.select("o_orderkey", F.col("yy").cast("int").alias("year"), (F.col("o_orderkey") % 14).cast("int").alias("month"))
    return t.select("o_orderkey", "year", "month", format_period(period(F.col("year"), F.col("month"))).alias("period_text"))


NOTES_SQL = "WITH " + ORDERS_DATES_SQL + f""",
per AS (
  SELECT o_custkey AS file,
    CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE arg_min(struct_pack(year := CAST(yy AS INTEGER), month := CAST(mm AS INTEGER)), o_orderkey) END AS tp,
    CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE arg_max(struct_pack(year := CAST(yy AS INTEGER), month := CAST(mm AS INTEGER)), o_orderdate) END AS fp,
    CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE arg_min(struct_pack(year := CAST(yy AS INTEGER), month := CAST(mm AS INTEGER)), o_orderdate) END AS hp
  FROM od GROUP BY o_custkey),
fmt AS (
  SELECT file, tp, fp, hp,
    {td.format_period_sql('tp.year', 'tp.month')} AS ts,
    {td.format_period_sql('fp.year', 'fp.month')} AS fs,
    {td.format_period_sql('hp.year', 'hp.month')} AS hs
  FROM per),
n AS (
  SELECT file,
    CASE WHEN tp IS NOT NULL AND fp IS NOT NULL AND fp IS DISTINCT FROM tp THEN 'Filename suggests ' || fs || '; table period is ' || ts || '.' END AS n1,
    CASE WHEN tp IS NOT NULL AND hp IS NOT NULL AND hp IS DISTINCT FROM tp THEN 'Header suggests ' || hs || '; table period is ' || ts || '.' END AS n2,
    CASE WHEN tp IS NOT NULL AND fp IS NOT NULL AND hp IS NOT NULL AND fp IS DISTINCT FROM hp THEN 'Filename suggests ' || fs || '; header suggests ' || hs || '.' END AS n3
  FROM fmt)
SELECT file, CAST((n1 IS NOT NULL)::INT + (n2 IS NOT NULL)::INT + (n3 IS NOT NULL)::INT AS INTEGER) AS n_notes,
  concat_ws(' / ', n1, n2, n3) AS notes FROM n"""


@register("discrepancy_notes", NOTES_SQL)
def q_discrepancy_notes(spark, sf_dir):
    from ledgerfold.functions.periods import discrepancy_notes, period

    d = _orders_dates(spark, sf_dir)
    p = period(F.col("yy"), F.col("mm"))
    per = d.groupBy(F.col("o_custkey").alias("file")).agg(
        F.min_by(p, "o_orderkey").alias("tp"),
        F.max_by(p, "o_orderdate").alias("fp"),
        F.min_by(p, "o_orderdate").alias("hp"),
    )
    f = F.col("file")
    per = per.select(
        "file",
        F.when(f % 10 == 0, F.lit(None)).otherwise(F.col("tp")).alias("tp"),
        F.when(f % 7 == 0, F.lit(None)).otherwise(F.col("fp")).alias("fp"),
        F.when(f % 5 == 0, F.lit(None)).otherwise(F.col("hp")).alias("hp"),
    )
    notes = per.select("file", discrepancy_notes("tp", "fp", "hp").alias("notes"))
    return notes.select("file", F.size("notes").cast("int").alias("n_notes"), F.array_join("notes", " / ").alias("notes"))


# ------------------------------------------------------------------ explore view

JS_TEXT_SQL = "regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


def _js_sql(x: str) -> str:
    return "coalesce(" + JS_TEXT_SQL.format(x=x) + ", '')"


def _customer(spark, sf_dir):
    return td.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")


SEARCH_SQL = f"""
SELECT c_custkey, c_name, c_acctbal, c_mktsegment, CASE WHEN c_custkey % 9 = 0 THEN 1e30 ELSE 0.5 END AS huge FROM customer
WHERE contains(lower({_js_sql('c_custkey')}), '12') OR contains(lower(coalesce(c_name, '')), '12')
   OR contains(lower({_js_sql('c_acctbal')}), '12') OR contains(lower(coalesce(c_mktsegment, '')), '12')
   OR contains(CASE WHEN c_custkey % 9 = 0 THEN '1e+30' ELSE '0.5' END, '12')"""


@register("search_rows", SEARCH_SQL)
def q_search_rows(spark, sf_dir):
    from ledgerfold.operators.explore import search_rows

    c = _customer(spark, sf_dir).drop("c_nationkey")
    huge = F.when(F.col("c_custkey") % 9 == 0, F.lit(1e30)).otherwise(F.lit(0.5))
    return search_rows(c.withColumn("huge", huge), " 12 ")


@register("facet_filter", """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def q_facet_filter(spark, sf_dir):
    from ledgerfold.operators.explore import facet_filter

    o = td.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return facet_filter(o, {"o_orderstatus": ["F", " O"], "o_orderpriority": ["1-URGENT", "2-HIGH "], "o_orderkey": []})


SORT_SRC_SQL = """s AS (
  SELECT o_orderkey, o_orderstatus,
    CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS amount
  FROM orders)"""


def _sort_src(spark, sf_dir):
    o = td.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 10
    return o.select(
        "o_orderkey", "o_orderstatus",
        F.when(k == 0, F.lit(None).cast("double")).when(k == 1, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("amount"),
    )


@register("user_sort", "WITH " + SORT_SRC_SQL + """
SELECT o_orderkey, o_orderstatus, amount,
  row_number() OVER (ORDER BY isnan(coalesce(amount, 0.0)), coalesce(amount, 0.0) DESC, o_orderkey) AS rank
FROM s""")
def q_user_sort(spark, sf_dir):
    from ledgerfold.operators.explore import sort_rank

    return sort_rank(_sort_src(spark, sf_dir), "amount", "desc", order_col="o_orderkey")


@register("user_sort_date", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (ORDER BY strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) AS rank FROM orders""")
def q_user_sort_date(spark, sf_dir):
    from ledgerfold.operators.explore import sort_rank

    o = td.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    ranked = sort_rank(o, "o_orderdate", "asc", order_col="o_orderkey")
    return ranked.select("o_orderkey", F.col("o_orderdate").cast("string").alias("day"), "rank")


@register("user_sort_text", """
WITH s AS (SELECT c_custkey, c_nationkey,
  CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_mktsegment WHEN 2 THEN NULL
    ELSE lower(substr(c_mktsegment, 1, 1)) || substr(c_mktsegment, 2) END AS seg FROM customer)
SELECT c_custkey, c_nationkey, seg,
  row_number() OVER (ORDER BY lower(coalesce(seg, '')), c_custkey) AS rank
FROM s""")
def q_user_sort_text(spark, sf_dir):
    from ledgerfold.operators.explore import sort_rank

    c = _customer(spark, sf_dir)
    k = F.col("c_custkey") % 4
    seg = (
        F.when(k == 0, F.lower("c_mktsegment")).when(k == 1, F.col("c_mktsegment")).when(k == 2, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lower(F.substring("c_mktsegment", 1, 1)), F.expr("substring(c_mktsegment, 2)")))
    )
    s = c.select("c_custkey", "c_nationkey", seg.alias("seg"))
    return sort_rank(s, "seg", "asc", order_col="c_custkey")


@register("page_slice", """
WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn,
  count(*) OVER () AS n FROM orders),
p AS (SELECT least(999999, greatest(0, CAST(ceil(max(n) / 25.0) AS BIGINT) - 1)) * 25 AS off FROM r)
SELECT o_orderkey, o_totalprice FROM r, p WHERE rn > off AND rn <= off + 25""")
def q_page_slice(spark, sf_dir):
    from ledgerfold.operators.explore import page_slice

    o = td.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return page_slice(o, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 999999, 25)


@register("page_info", """
WITH f AS (SELECT * FROM customer WHERE contains(lower(coalesce(c_mktsegment, '')), 'ma')),
n AS (SELECT count(*) AS total_rows, CAST(ceil(count(*) / 25.0) AS BIGINT) AS page_count FROM f),
i AS (SELECT total_rows, page_count, CAST(least(greatest(0, 7), greatest(0, page_count - 1)) AS BIGINT) AS page_index FROM n)
SELECT total_rows, page_count, page_index,
  CAST(CASE WHEN total_rows = 0 THEN 0 ELSE page_index * 25 + 1 END AS BIGINT) AS range_start,
  CAST(least(page_index * 25 + 25, total_rows) AS BIGINT) AS range_end FROM i""")
def q_page_info(spark, sf_dir):
    from ledgerfold.operators.explore import page_info, search_rows

    c = _customer(spark, sf_dir)
    return page_info(search_rows(c, "MA", ["c_mktsegment"]), 7, 25)


@register("explore_table", f"""
WITH f AS (
  SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer
  WHERE (contains(lower({_js_sql('c_custkey')}), '1') OR contains(lower(coalesce(c_name, '')), '1')
     OR contains(lower({_js_sql('c_acctbal')}), '1') OR contains(lower(coalesce(c_mktsegment, '')), '1'))
    AND c_mktsegment IN ('BUILDING', 'MACHINERY')),
r AS (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn FROM f)
SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM r WHERE rn > 20 AND rn <= 30""")
def q_explore_table(spark, sf_dir):
    from ledgerfold.operators.explore import explore

    c = _customer(spark, sf_dir).drop("c_nationkey")
    return explore(c, search=" 1", facets={"c_mktsegment": ["BUILDING", "MACHINERY"]}, sort_column="c_acctbal",
                   direction="desc", order_col="c_custkey", page_index=2, page_size=10)


@register("stored_order", """
WITH r AS (SELECT o_orderkey, o_totalprice, o_orderstatus, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_orderstatus IN ('F', 'O')),
t AS (SELECT row_number() OVER (ORDER BY lower(o_orderpriority) DESC, o_orderkey) AS rn, o_orderkey, o_totalprice FROM orders),
n AS (SELECT (CAST(ceil(count(*) / 50.0) AS BIGINT) - 1) * 50 AS off FROM r)
SELECT 'third page' AS request, o_orderkey, o_totalprice FROM r WHERE rn > 100 AND rn <= 150
UNION ALL SELECT 'after it', o_orderkey, o_totalprice FROM r WHERE rn > 150 AND rn <= 220
UNION ALL SELECT 'last page', o_orderkey, o_totalprice FROM r, n WHERE rn > off
UNION ALL SELECT 'text order', o_orderkey, o_totalprice FROM t WHERE rn > 300 AND rn <= 325""")
def q_stored_order(spark, sf_dir):
    """Four requests on one view: three share one stored order, by offset and after a row."""
    from ledgerfold.operators.stored_order import TableView

    o = td.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    view = TableView(o, "o_orderkey")
    request = {"facets": {"o_orderstatus": ["F", "O"]}, "sort_column": "o_totalprice", "direction": "desc"}
    third = view.page(2, 50, **request)
    order = view.order(**request)
    last = third.orderBy("o_totalprice", F.desc("o_orderkey")).first()
    pages = {
        "third page": third, "after it": order.seek(order.key_of(F.col("o_orderkey") == last["o_orderkey"]), 70),
        "last page": view.page(10**6, 50, **request), "text order": view.page(12, 25, sort_column="o_orderpriority", direction="desc"),
    }
    out = [df.select(F.lit(name).alias("request"), "o_orderkey", "o_totalprice") for name, df in pages.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


DISTINCT_SRC_SQL = """s AS (SELECT CASE c_custkey % 5 WHEN 0 THEN ' ' || c_mktsegment || ' ' WHEN 1 THEN lower(c_mktsegment)
  WHEN 2 THEN c_mktsegment WHEN 3 THEN NULL ELSE '' END AS seg FROM customer)"""


def _distinct_src(spark, sf_dir):
    c = _customer(spark, sf_dir)
    k = F.col("c_custkey") % 5
    seg = (
        F.when(k == 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).when(k == 1, F.lower("c_mktsegment"))
        .when(k == 2, F.col("c_mktsegment")).when(k == 3, F.lit(None).cast("string")).otherwise(F.lit(""))
    )
    return c.select(seg.alias("seg"))


@register("distinct_values", "WITH " + DISTINCT_SRC_SQL + """
SELECT DISTINCT trim(seg) AS value FROM s WHERE seg IS NOT NULL AND seg <> ''""")
def q_distinct_values(spark, sf_dir):
    from ledgerfold.operators.explore import distinct_values

    return distinct_values(_distinct_src(spark, sf_dir), "seg")


@register("distinct_values_search", "WITH " + DISTINCT_SRC_SQL + """
SELECT DISTINCT trim(seg) AS value FROM s WHERE seg IS NOT NULL AND seg <> '' AND contains(lower(trim(seg)), 'ing')""")
def q_distinct_values_search(spark, sf_dir):
    from ledgerfold.operators.explore import distinct_values

    return distinct_values(_distinct_src(spark, sf_dir), "seg", search=" ING ")


PROFILE_SRC_SQL = """s AS (SELECT event_id, event_type, props,
  CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN NULL ELSE CAST(value AS VARCHAR) END AS value_text,
  CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS user_text FROM events)"""


def _num_sql(c: str) -> str:
    return (f"coalesce(bool_and(NOT ({c} IS NOT NULL AND {c} <> '' AND "
            f"({td.lenient_float_sql(c)}) IS NULL)), true)")


@register("profile_numeric", "WITH " + PROFILE_SRC_SQL + f"""
SELECT 'event_id' AS column_name, true AS is_numeric
UNION ALL SELECT 'event_type', {_num_sql('event_type')} FROM s
UNION ALL SELECT 'props', {_num_sql('props')} FROM s
UNION ALL SELECT 'value_text', {_num_sql('value_text')} FROM s
UNION ALL SELECT 'user_text', {_num_sql('user_text')} FROM s
UNION ALL SELECT 'day', false""")
def q_profile_numeric(spark, sf_dir):
    from ledgerfold.operators.explore import profile_numeric

    ev = td.table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    s = ev.select(
        "event_id", "event_type", "props",
        F.when(k == 0, F.lit("")).when(k == 1, F.lit(None).cast("string")).otherwise(F.col("value").cast("string")).alias("value_text"),
        F.when(F.col("event_id") % 97 == 0, F.lit("n/a")).otherwise(F.col("user_id").cast("string")).alias("user_text"),
        F.lit("2025-01-31").cast("date").alias("day"),
    )
    return profile_numeric(s)


def _fmt2_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(format('{{:,.2f}}', round({x}, 2)), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


@register("format_values", f"""
SELECT l.row_idx, {_fmt2_sql('l_extendedprice')} AS amount_text,
  {_fmt2_sql('l_discount * 100')} || '%' AS discount_text,
  '$' || format('{{:,.2f}}', l_extendedprice) AS money_text,
  regexp_replace(CAST(CAST(year(l_shipdate) AS DOUBLE) AS VARCHAR), '\\.0$', '') AS year_text
FROM ({td.LINEITEM_ROWS_SQL.replace('lineitem_rows AS (', '', 1)[:-1]}) l""")
def q_format_values(spark, sf_dir):
    from ledgerfold.functions.text import currency_display, number_display, percent_display

    li = td.lineitem_rows(spark, sf_dir)
    return li.select(
        "row_idx",
        number_display("l_extendedprice").alias("amount_text"),
        percent_display("l_discount").alias("discount_text"),
        currency_display("l_extendedprice").alias("money_text"),
        js_text_col(F.year("l_shipdate")).alias("year_text"),
    )


def js_text_col(c):
    from ledgerfold.functions.numbers import js_text

    return js_text(c.cast("double"))


@register("truncate_label", """
WITH s AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS label FROM part)
SELECT p_partkey, CASE WHEN length(label) > 20 THEN left(label, 8) || '…' || right(label, 8) ELSE label END AS short_label,
  CASE WHEN length(label) > 26 THEN left(label, 11) || '...' || right(label, 11) ELSE label END AS file_label
FROM s""")
def q_truncate_label(spark, sf_dir):
    from ledgerfold.functions.text import truncate_middle

    p = td.table(spark, sf_dir, "part")
    s = p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("label"))
    return s.select("p_partkey", truncate_middle("label", 20).alias("short_label"),
                    truncate_middle("label", 26, "...").alias("file_label"))


@register("shuffle_points", "SELECT *, CAST(row_number() OVER (ORDER BY md5('11|' || label)) AS INTEGER) AS place FROM (" + TOP_ENTITIES_SQL + ") t")
def q_shuffle_points(spark, sf_dir):
    return summaries.shuffle_points(q_top_entities(spark, sf_dir), seed=11)


ENVELOPE_COLUMNS = ("file,captive_name_captive_name,captive_name_client,gross_written_premium,taxes,"
                    "popic_fee_rlip,total_available_units")


@register("envelope", CONSOLIDATE_SQL.replace(
    "SELECT file, captive AS captive_name_captive_name", "SELECT count(*) AS total_rows, '" + ENVELOPE_COLUMNS
    + "' AS columns FROM (SELECT file, captive AS captive_name_captive_name", 1) + ") t")
def q_envelope(spark, sf_dir):
    data = q_consolidate(spark, sf_dir)
    return data.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.lit(",".join(data.columns)).alias("columns")
    )


# ------------------------------------------------------------------ headers


def _part(spark, sf_dir):
    return td.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")


CLEAN_SRC_SQL = """CASE p_partkey % 4 WHEN 0 THEN p_name || ' ↑' WHEN 1 THEN '  ' || p_name || '↑ '
  WHEN 2 THEN p_type ELSE ' ' || p_brand || ' ' END"""


@register("header_clean", f"""
SELECT p_partkey, {CLEAN_SRC_SQL} AS raw, trim(replace({CLEAN_SRC_SQL}, '↑', '')) AS cleaned FROM part""")
def q_header_clean(spark, sf_dir):
    from ledgerfold.functions.text import clean_header

    p = _part(spark, sf_dir)
    k = F.col("p_partkey") % 4
    raw = (
        F.when(k == 0, F.concat("p_name", F.lit(" ↑"))).when(k == 1, F.concat(F.lit("  "), "p_name", F.lit("↑ ")))
        .when(k == 2, F.col("p_type")).otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" ")))
    )
    t = p.select("p_partkey", raw.alias("raw"))
    return t.select("p_partkey", "raw", clean_header("raw").alias("cleaned"))


NORM_SRC_SQL = """CASE p_partkey % 5 WHEN 0 THEN upper(p_name) || ' #!' WHEN 1 THEN p_name || ':  ' || p_type
  WHEN 2 THEN '  ' || p_brand || chr(9) WHEN 3 THEN replace(p_name, ' ', ' ' || chr(160) || ' ') || '?' ELSE '%%' END"""


def _norm_sql(x: str) -> str:
    spaces = "".join(chr(c) for c in td.SPACE_CODES if c > 32)
    return (f"trim(regexp_replace(regexp_replace(lower({td.strip_sql(x)}), '[^a-z0-9\\s\\x1c-\\x1f{spaces}]', '', 'g'), '[\\s\\x0b\\x1c-\\x1f{spaces}]+', ' ', 'g'))")


@register("header_normalize", f"""
SELECT p_partkey, {NORM_SRC_SQL} AS raw, {_norm_sql(NORM_SRC_SQL)} AS normalized FROM part""")
def q_header_normalize(spark, sf_dir):
    from ledgerfold.functions.text import normalize_header

    p = _part(spark, sf_dir)
    k = F.col("p_partkey") % 5
    raw = (
        F.when(k == 0, F.concat(F.upper("p_name"), F.lit(" #!"))).when(k == 1, F.concat("p_name", F.lit(":  "), "p_type"))
        .when(k == 2, F.concat(F.lit("  "), "p_brand", F.lit("\t"))).when(k == 3, F.concat(F.regexp_replace("p_name", " ", " \u00a0 "), F.lit("?")))
        .otherwise(F.lit("%%"))
    )
    t = p.select("p_partkey", raw.alias("raw"))
    return t.select("p_partkey", "raw", normalize_header("raw").alias("normalized"))


TOKEN_SRC_SQL = """CASE p_partkey % 6 WHEN 0 THEN 'Captive Name ' || p_name WHEN 1 THEN 'captiev nme ' || p_type
  WHEN 2 THEN 'Client ' || p_brand WHEN 3 THEN 'cliant' WHEN 4 THEN 'Sales Person ' || p_name ELSE 'Referrer ' || p_type END"""


def _any_sql(n: str, toks) -> str:
    return "(" + " OR ".join(f"contains({n}, '{t}')" for t in toks) + ")"


def _tokens_sql() -> str:
    from ledgerfold.operators.headers import (CAPTIVE_TOKENS, CLIENT_TOKENS, NAME_TOKENS, SALESPERSON_TOKENS,
                                              VENDOR_TOKENS)

    n = "n"
    return (f"({n} <> '' AND {_any_sql(n, CAPTIVE_TOKENS)} AND {_any_sql(n, NAME_TOKENS)}) AS captive_rule, "
            f"({n} <> '' AND {_any_sql(n, CLIENT_TOKENS)}) AS client_rule, "
            f"({n} <> '' AND {_any_sql(n, SALESPERSON_TOKENS)}) AS salesperson_rule, "
            f"({n} <> '' AND {_any_sql(n, VENDOR_TOKENS)}) AS vendor_rule")


@register("header_tokens", f"""
WITH s AS (SELECT p_partkey, {TOKEN_SRC_SQL} AS raw FROM part),
t AS (SELECT p_partkey, raw, {_norm_sql('raw')} AS n FROM s)
SELECT p_partkey, raw, {_tokens_sql()} FROM t""")
def q_header_tokens(spark, sf_dir):
    from ledgerfold.functions.text import normalize_header
    from ledgerfold.operators.headers import tokens_match

    p = _part(spark, sf_dir)
    k = F.col("p_partkey") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit("Captive Name "), "p_name")).when(k == 1, F.concat(F.lit("captiev nme "), "p_type"))
        .when(k == 2, F.concat(F.lit("Client "), "p_brand")).when(k == 3, F.lit("cliant"))
        .when(k == 4, F.concat(F.lit("Sales Person "), "p_name")).otherwise(F.concat(F.lit("Referrer "), "p_type"))
    )
    t = p.select("p_partkey", raw.alias("raw")).withColumn("n", normalize_header("raw"))
    return t.select(
        "p_partkey", "raw",
        *[tokens_match(F.lit(r), F.col("n")).alias(f"{r}_rule") for r in ("captive", "client", "salesperson", "vendor")],
    )


UNIQ_SQL = """WITH h AS (SELECT CAST(p_partkey // 20 AS VARCHAR) AS file, CAST(p_partkey % 20 AS INTEGER) AS col_idx,
    CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE p_type END AS header FROM part),
b AS (SELECT *, CASE WHEN trim(coalesce(header, '')) = '' THEN 'column' ELSE trim(header) END AS base FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY file, base ORDER BY col_idx) AS k FROM b)
SELECT file, col_idx, header, CASE WHEN k > 1 THEN base || '_' || CAST(k AS VARCHAR) ELSE base END AS name FROM r"""


def _part_header_table(spark, sf_dir, header):
    p = _part(spark, sf_dir)
    return p.select(
        F.expr("p_partkey div 20").cast("string").alias("file"), (F.col("p_partkey") % 20).cast("int").alias("col_idx"),
        header.alias("header"),
    )


@register("uniquify_headers", UNIQ_SQL)
def q_uniquify_headers(spark, sf_dir):
    from ledgerfold.operators.headers import uniquify_headers

    k = F.col("p_partkey") % 7
    h = _part_header_table(spark, sf_dir, F.when(k == 0, F.lit("")).when(k == 1, F.lit("  ")).otherwise(F.col("p_type")))
    return uniquify_headers(h)


ISSUES_SQL = """WITH h AS (SELECT CAST(p_partkey // 20 AS VARCHAR) AS file, CAST(p_partkey % 20 AS INTEGER) AS col_idx,
    CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN 'Unnamed' WHEN 3 THEN 'NULL' WHEN 4 THEN p_type || ' ↑'
      WHEN 5 THEN NULL WHEN 6 THEN split_part(p_type, ' ', 1) || '''s ' || p_brand ELSE p_type END AS header FROM part),
c AS (SELECT *, coalesce(trim(replace(header, '↑', '')), '') AS name FROM h),
n AS (SELECT *, (name = '' OR regexp_matches(name, '^[A-Za-z]$') OR lower(name) IN ('unnamed', 'column', 'null', 'none')) AS nuisance FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY file, name, nuisance ORDER BY col_idx) AS k FROM n),
p AS (SELECT *, CASE WHEN header IS NULL THEN '''None''' WHEN contains(name, '''') THEN '"' || name || '"' ELSE '''' || name || '''' END AS shown FROM r),
i AS (SELECT file, col_idx, CASE WHEN nuisance THEN 'Omitted nuisance column at index ' || CAST(col_idx AS VARCHAR) || ': ' || shown
     WHEN k > 1 THEN 'Omitted duplicate column at index ' || CAST(col_idx AS VARCHAR) || ': ' || shown END AS issue FROM p)
SELECT file, count(*) AS n_issues, string_agg(issue, ' | ' ORDER BY col_idx) AS header_issues
FROM i WHERE issue IS NOT NULL GROUP BY file"""


@register("header_issues", ISSUES_SQL)
def q_header_issues(spark, sf_dir):
    from ledgerfold.operators.headers import header_issues, issues_per_file

    k = F.col("p_partkey") % 9
    hdr = (
        F.when(k == 0, F.lit("")).when(k == 1, F.lit("x")).when(k == 2, F.lit("Unnamed")).when(k == 3, F.lit("NULL"))
        .when(k == 4, F.concat("p_type", F.lit(" ↑")))
        .when(k == 5, F.lit(None).cast("string")).when(k == 6, F.concat(F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit("'s "), "p_brand"))
        .otherwise(F.col("p_type"))
    )
    per = issues_per_file(header_issues(_part_header_table(spark, sf_dir, hdr)))
    return per.select("file", "n_issues", F.array_join("header_issues", " | ").alias("header_issues"))


def _perturbed_canonical(spark, sf_dir, names, width: int):
    """Observed headers made from canonical names with typos, case, symbols and
    sort arrows; files of ``width`` columns cut from the part table."""
    p = _part(spark, sf_dir)
    n = len(names)
    arr = F.array(*[F.lit(x) for x in names])
    name = F.element_at(arr, (F.col("p_partkey") % n + 1).cast("int"))
    kind = (F.col("p_partkey") / n).cast("long") % 5
    pos = (F.col("p_partkey") % 7 + 2).cast("int")
    typo = F.concat(F.substring(name, F.lit(1), pos - 1), F.substring(name, pos + 1, F.lit(1000)))
    hdr = (
        F.when(kind == 0, name).when(kind == 1, F.concat(F.lower(name), F.lit(" #")))
        .when(kind == 2, typo).when(kind == 3, F.concat(F.upper(name), F.lit(" ↑")))
        .otherwise(F.concat(F.lit("  "), name))
    )
    return p.select(
        F.expr(f"p_partkey div {width}").cast("string").alias("file"),
        (F.col("p_partkey") % width).cast("int").alias("col_idx"),
        hdr.alias("header"),
    )


@register("header_similarity")
def q_header_similarity(spark, sf_dir):
    from ledgerfold.operators.headers import match_pairs

    h = _perturbed_canonical(spark, sf_dir, CAPTIVE_SPEC.canonical, 31)
    return match_pairs(h, CAPTIVE_SPEC.canonical, score_all=True).select("header", "canonical", "exact", "ratio")


@register("header_match")
def q_header_match(spark, sf_dir):
    from ledgerfold.operators.headers import match_pairs

    h = _perturbed_canonical(spark, sf_dir, CAPTIVE_SPEC.canonical, 31)
    return match_pairs(h, CAPTIVE_SPEC.canonical).filter("matched").select("header", "canonical", "ratio")


def _table_headers(spark, sf_dir):
    """Headers from the tables' own texts: part names and types, names of the report with a
    part's word before or behind, and misspelt names."""
    p = _part(spark, sf_dir)
    names = F.array(*[F.lit(x) for x in CAPTIVE_SPEC.canonical])
    name = F.element_at(names, (F.col("p_partkey") % len(CAPTIVE_SPEC.canonical) + 1).cast("int"))
    word = F.split_part("p_type", F.lit(" "), F.lit(3))
    own = p.select(F.explode(F.array("p_name", "p_type", F.concat(word, F.lit(" "), name), F.concat(name, F.lit(" "), "p_brand"))).alias("header"))
    return own.unionByName(_perturbed_canonical(spark, sf_dir, CAPTIVE_SPEC.canonical, 31).select("header"))


def _candidates_sql() -> str:
    from ledgerfold.operators.headers import LETTERS
    from ledgerfold.plans import header_oracles as O
    from ledgerfold.spec import KEY_RULES

    names = ", ".join(f"({O._quoted(c)}, {O._quoted(KEY_RULES[c]) if c in KEY_RULES else 'NULL'})" for c in CAPTIVE_SPEC.canonical)
    listed = "[" + ", ".join(O._quoted(c) for c in CAPTIVE_SPEC.canonical) + "]"
    name = f"{listed}[p_partkey % {len(CAPTIVE_SPEC.canonical)} + 1]"
    norm = "trim(regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
    letters = "[" + ", ".join(O._quoted(c) for c in LETTERS) + "]"
    times = "(length({t}) - length(replace({t}, c, '')))"
    shared = f"list_sum(list_transform({letters}, lambda c: least({times.format(t='n_act')}, {times.format(t='n_can')})))"
    return f"""WITH {O._headers_sql()},
all_texts AS (SELECT header FROM h UNION ALL SELECT unnest([p_name, p_type, split_part(p_type, ' ', 3) || ' ' || {name}, {name} || ' ' || p_brand]) FROM part),
d AS (SELECT DISTINCT header, {norm.format(x='header')} AS n_act FROM all_texts),
r AS (SELECT canonical, rule, {norm.format(x='canonical')} AS n_can FROM (VALUES {names}) AS t(canonical, rule)),
p AS (SELECT header, canonical, n_act = n_can AS exact, coalesce(CASE rule WHEN 'captive' THEN {O._any(O.CAPTIVE_TOKENS)} AND {O._any(O.NAME_TOKENS)}
    WHEN 'client' THEN {O._any(O.CLIENT_TOKENS)} END, false) AS token, {shared} * 2.0 / (length(n_act) + length(n_can)) AS bound FROM d, r WHERE n_act <> '')
SELECT DISTINCT header, canonical, exact, token FROM p WHERE bound >= CASE WHEN token THEN {O.TOKEN_RATIO} ELSE {O.EXACT_RATIO} END"""


@register("header_candidates", _candidates_sql())
def q_header_candidates(spark, sf_dir):
    from ledgerfold.operators.header_index import candidates
    from ledgerfold.spec import KEY_RULES

    names = spark.createDataFrame([(c, KEY_RULES.get(c)) for c in CAPTIVE_SPEC.canonical], "canonical string, rule string")
    return candidates(_table_headers(spark, sf_dir), names).select("header", "canonical", "exact", "token")


@register("header_mapping")
def q_header_mapping(spark, sf_dir):
    from ledgerfold.operators.headers import prepare_headers, resolve_mapping

    h = _perturbed_canonical(spark, sf_dir, CAPTIVE_SPEC.canonical, 31)
    return resolve_mapping(prepare_headers(h, CAPTIVE_SPEC), CAPTIVE_SPEC.canonical, "best")


@register("header_mapping_first")
def q_header_mapping_first(spark, sf_dir):
    from ledgerfold.operators.headers import prepare_headers, resolve_mapping

    h = _perturbed_canonical(spark, sf_dir, CAPTIVE_SPEC.canonical, 31)
    return resolve_mapping(prepare_headers(h, CAPTIVE_SPEC), CAPTIVE_SPEC.canonical, "first")


# ------------------------------------------------------------------ file gates


def _page_headers(spark, sf_dir):
    from ledgerfold.spec import CAPTIVE_KEY, CAPTIVE_TARGETS

    pg = td.table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("n_html"))
    pid = F.col("page_id")
    targets = F.array(*[F.lit(t) for t in CAPTIVE_TARGETS])
    cols = F.concat(
        F.when(pid % 7 != 0, F.array(F.lit(CAPTIVE_KEY))).otherwise(F.array().cast("array<string>")),
        F.slice(targets, 1, (pid % 15).cast("int")),
        F.when(pid % 3 != 0, F.array(F.lit("POPIC Fee RLIP"))).otherwise(F.array().cast("array<string>")),
        F.when(pid % 3 != 1, F.array(F.lit("POPIC Fee RAP"))).otherwise(F.array().cast("array<string>")),
    )
    return pg.select(F.concat(F.lit("page_"), pid.cast("string")).alias("file"), "page_id", "url", "n_html",
                     F.array_distinct(cols).alias("cols"))


def _page_headers_sql() -> str:
    from ledgerfold.spec import CAPTIVE_KEY, CAPTIVE_TARGETS

    targets = "[" + ", ".join("'" + t + "'" for t in CAPTIVE_TARGETS) + "]"
    return f"""ph AS (
  SELECT 'page_' || CAST(page_id AS VARCHAR) AS file, page_id, url, length(html) AS n_html,
    list_distinct(list_concat(
      CASE WHEN page_id % 7 <> 0 THEN ['{CAPTIVE_KEY}'] ELSE [] END,
      list_slice({targets}, 1, page_id % 15),
      CASE WHEN page_id % 3 <> 0 THEN ['POPIC Fee RLIP'] ELSE [] END,
      CASE WHEN page_id % 3 <> 1 THEN ['POPIC Fee RAP'] ELSE [] END)) AS cols
  FROM pages),
mapped AS (SELECT file, unnest(cols) AS canonical FROM ph)"""


@register("detect_type", "WITH " + _page_headers_sql() + """,
t AS (SELECT file, bool_or(contains(canonical, 'RLIP')) AS l, bool_or(contains(canonical, 'RAP')) AS r FROM mapped GROUP BY file),
rc AS (SELECT file, CASE WHEN page_id % 11 = 0 THEN 0 ELSE n_html END AS n_rows FROM ph)
SELECT t.file, CASE WHEN l AND coalesce(n_rows, 0) > 0 AND NOT (r AND coalesce(n_rows, 0) > 0) THEN 'RLIP-only'
  WHEN r AND coalesce(n_rows, 0) > 0 AND NOT (l AND coalesce(n_rows, 0) > 0) THEN 'RAP-only' ELSE 'combined' END AS file_type
FROM t LEFT JOIN rc USING (file)""")
def q_detect_type(spark, sf_dir):
    from ledgerfold.operators.headers import detect_type

    ph = _page_headers(spark, sf_dir)
    mapped = ph.select("file", F.explode("cols").alias("canonical"))
    rc = ph.select("file", F.when(F.col("page_id") % 11 == 0, F.lit(0)).otherwise(F.col("n_html")).alias("n_rows"))
    return detect_type(mapped, rc)


VALIDATE_SQL = "WITH " + _page_headers_sql() + """,
per AS (SELECT file, count(DISTINCT canonical) FILTER (WHERE canonical IN ({targets})) AS n_targets,
        bool_or(canonical = 'Captive Name: Captive Name') AS req FROM mapped GROUP BY file),
v AS (SELECT ph.file, CAST(coalesce(n_targets, 0) AS BIGINT) AS n_targets, coalesce(req, false) AS has_required FROM ph LEFT JOIN per USING (file))
SELECT file, n_targets, has_required, (has_required AND n_targets >= 9) AS ok,
  CASE WHEN NOT has_required THEN 'Missing required columns.' WHEN n_targets < 9 THEN 'Upload a valid Salesforce Captive Report file.' END AS error
FROM v"""


def _validate_sql():
    from ledgerfold.spec import CAPTIVE_TARGETS

    return VALIDATE_SQL.replace("{targets}", ", ".join("'" + t + "'" for t in CAPTIVE_TARGETS))


@register("validate_files", _validate_sql())
def q_validate_files(spark, sf_dir):
    from ledgerfold.operators.headers import validate_files

    ph = _page_headers(spark, sf_dir)
    mapped = ph.select("file", F.explode("cols").alias("canonical"))
    return validate_files(mapped, CAPTIVE_SPEC, ph.select("file"))


ADMISSION_SQL = """adm AS (
  SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.XLS' WHEN 2 THEN '.csv' WHEN 3 THEN '.pdf'
    ELSE '.Xlsx' END AS path FROM pages),
a AS (SELECT page_id, path, regexp_matches(lower(path), '\\.(xlsx|xls|csv)$') AS admitted, page_id // 3 AS batch FROM adm),
b AS (SELECT batch, bool_and(admitted) AND count(*) <= 3 AS batch_ok FROM a GROUP BY batch)"""


def _admission(spark, sf_dir):
    from ledgerfold.sources.files import admit_files

    pg = td.table(spark, sf_dir, "pages")
    k = F.col("page_id") % 5
    ext = F.when(k == 0, ".xlsx").when(k == 1, ".XLS").when(k == 2, ".csv").when(k == 3, ".pdf").otherwise(".Xlsx")
    files = pg.select("page_id", F.concat("url", ext).alias("path"), F.expr("page_id div 3").alias("batch"))
    return admit_files(files, path_col="path", batch_col="batch", max_files=3)


@register("file_admission", "WITH " + ADMISSION_SQL + """
SELECT page_id, path, admitted, batch_ok FROM a JOIN b USING (batch)""")
def q_file_admission(spark, sf_dir):
    return _admission(spark, sf_dir).select("page_id", "path", "admitted", "batch_ok")


@register("ingest_status", "WITH " + ADMISSION_SQL + ", " + _validate_sql()[5:].replace(
    "SELECT file, n_targets, has_required, (has_required AND n_targets >= 9) AS ok,",
    ", vv AS (SELECT file, (has_required AND n_targets >= 9) AS ok,") + """ )
SELECT 'page_' || CAST(a.page_id AS VARCHAR) AS file,
  CASE WHEN NOT b.batch_ok THEN 'rejected' WHEN vv.ok THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN NOT b.batch_ok THEN 'Batch rejected: unsupported file type or too many files.' WHEN vv.ok IS NULL THEN 'The file was not read.' ELSE vv.error END AS error
FROM a JOIN b USING (batch) LEFT JOIN (SELECT * FROM vv WHERE substr(file, length(file)) <> '3') vv ON vv.file = 'page_' || CAST(a.page_id AS VARCHAR)""")
def q_ingest_status(spark, sf_dir):
    from ledgerfold.sources.files import ingest_status

    adm = _admission(spark, sf_dir).select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("file"), "batch_ok")
    # Some files have no validation row: they were never read.
    val = q_validate_files(spark, sf_dir).filter(~F.col("file").endswith("3"))
    return ingest_status(adm, val)


# ------------------------------------------------------------------ report files end to end


def _report(spark, sf_dir, family: str):
    from ledgerfold.plans import layouts
    from ledgerfold.plans.reports import ingest
    from ledgerfold.spec import SPECS

    spec = SPECS[family]
    layout = layouts.LAYOUTS[family]()
    rows = layouts.build_rows(spark, sf_dir, layout)
    # The rows come from joins and feed four branches: stage them once.
    return ingest(rows, spec, block_rows=1 << 12, stage_rows=True), layout, spec


def _report_data(spark, sf_dir, family: str):
    from ledgerfold.plans import layouts

    res, layout, spec = _report(spark, sf_dir, family)
    cols = ["file"] + layouts.output_columns(layout, spec)
    return _round_doubles(_snake_all(res.data.select(*cols)))


def _report_sql(family: str) -> str:
    from ledgerfold.plans import layouts
    from ledgerfold.spec import SPECS

    return layouts.consolidate_sql(layouts.LAYOUTS[family](), SPECS[family], snake)


@register("captive_report", _report_sql("captive"))
def q_captive_report(spark, sf_dir):
    return _report_data(spark, sf_dir, "captive")


@register("commission_report", _report_sql("commission"))
def q_commission_report(spark, sf_dir):
    return _report_data(spark, sf_dir, "commission")


@register("referral_report", _report_sql("referral"))
def q_referral_report(spark, sf_dir):
    return _report_data(spark, sf_dir, "referral")


# ------------------------------------------------------------------ table discovery on the captive workbooks


def _captive_rows(spark, sf_dir):
    from ledgerfold.plans import layouts

    return layouts.build_rows(spark, sf_dir, layouts.captive_layout())


def _layout_sql(name):
    from ledgerfold.plans import layouts

    return layouts.LAYOUTS[name]()


def _low_rows(spark, sf_dir):
    """The captive workbooks; in every fifth file the table starts 300 rows lower."""
    rows = _captive_rows(spark, sf_dir)
    return rows.withColumn("row_idx", F.when(F.length("file") % 5 == 0, F.col("row_idx") + 300).otherwise(F.col("row_idx")))


@register("table_start", f"""
SELECT {__import__('ledgerfold.plans.layouts', fromlist=['x']).file_name_sql('captive/')} AS file,
  CAST(n_nationkey % 4 + CASE WHEN length({__import__('ledgerfold.plans.layouts', fromlist=['x']).file_name_sql('captive/')}) % 5 = 0 THEN 300 ELSE 0 END AS BIGINT) AS start FROM nation""")
def q_table_start(spark, sf_dir):
    from ledgerfold.sources.tables import table_start
    from ledgerfold.spec import CAPTIVE_SPEC as spec

    return table_start(_low_rows(spark, sf_dir), spec).select("file", "start")


def _title_cells_sql():
    from ledgerfold.plans import layouts

    return "WITH " + layouts.rows_sql(layouts.captive_layout()) + """,
cells AS (SELECT file, row_idx, unnest(generate_series(0, len(values) - 1)) AS col_idx, unnest(values) AS value
          FROM rows WHERE row_idx < n_start),
x AS (SELECT 1)
SELECT file, CAST(row_idx AS BIGINT) AS row_idx, CAST(col_idx AS INTEGER) AS col_idx, trim(value) AS value
FROM cells WHERE value IS NOT NULL AND trim(value) <> ''"""


@register("title_cells", _title_cells_sql().replace(
    "FROM rows WHERE row_idx < n_start", "FROM rows JOIN (SELECT " + __import__('ledgerfold.plans.layouts', fromlist=['x'])
    .file_name_sql('captive/') + " AS f, n_nationkey % 4 AS n_start FROM nation) s ON s.f = rows.file WHERE row_idx < n_start"))
def q_title_cells(spark, sf_dir):
    from ledgerfold.sources.tables import table_start, title_cells
    from ledgerfold.spec import CAPTIVE_SPEC as spec

    rows = _captive_rows(spark, sf_dir)
    return title_cells(rows, table_start(rows, spec))


def _promote_sql():
    from ledgerfold.plans import layouts

    lay = layouts.captive_layout()
    seen = []
    for c in lay.columns:
        if c.canonical and c.canonical not in seen:
            seen.append(c.canonical)
    return "WITH " + layouts.base_sql(lay) + " SELECT file, CAST(row_idx AS BIGINT) AS row_idx, " + ", ".join(
        f'"{c}" AS {snake(c)}' for c in seen) + " FROM base"


@register("promote_header", _promote_sql())
def q_promote_header(spark, sf_dir):
    from ledgerfold.operators.headers import prepare_headers, resolve_mapping
    from ledgerfold.plans import layouts
    from ledgerfold.sources.tables import header_table, promote, table_start
    from ledgerfold.spec import CAPTIVE_SPEC as spec

    from ledgerfold.session import materialize

    lay = layouts.captive_layout()
    # Derived rows and the small header-side tables feed several branches:
    # write each once (as ingest does).
    rows = materialize(_captive_rows(spark, sf_dir))
    starts = materialize(table_start(rows, spec))
    mapping = materialize(resolve_mapping(prepare_headers(header_table(rows, starts, spec.scan_rows), spec),
                                          spec.canonical, "best"))
    wide = promote(rows, starts, mapping, spec.canonical, names=spec.column_names)
    present = list(dict.fromkeys(c.canonical for c in lay.columns if c.canonical))
    return wide.select("file", "row_idx", *[F.col(c).alias(snake(c)) for c in present])


# ------------------------------------------------------------------ report metadata


def _notes_sql(tp: str, fp: str, hp: str) -> str:
    ts = td.format_period_sql(f"{tp}.year", f"{tp}.month")
    fs = td.format_period_sql(f"{fp}.year", f"{fp}.month")
    hs = td.format_period_sql(f"{hp}.year", f"{hp}.month")
    return (
        f"CASE WHEN {tp} IS NULL THEN [] ELSE list_filter(["
        f"CASE WHEN {fp} IS NOT NULL AND {fp} IS DISTINCT FROM {tp} THEN 'Filename suggests ' || {fs} || '; table period is ' || {ts} || '.' END, "
        f"CASE WHEN {hp} IS NOT NULL AND {hp} IS DISTINCT FROM {tp} THEN 'Header suggests ' || {hs} || '; table period is ' || {ts} || '.' END, "
        f"CASE WHEN {fp} IS NOT NULL AND {hp} IS NOT NULL AND {fp} IS DISTINCT FROM {hp} THEN 'Filename suggests ' || {fs} || '; header suggests ' || {hs} || '.' END"
        f"], lambda x: x IS NOT NULL) END"
    )


def _report_metadata_sql() -> str:
    from ledgerfold.plans import layouts

    lay = layouts.captive_layout()
    fname = layouts.file_name_sql("captive/")
    base = layouts.base_sql(lay)
    ff = td.forward_fill_sql('"Captive Name: Captive Name"', "file", "row_idx")
    return f"""WITH {base},
filled AS (SELECT file, row_idx, {ff} AS cap, "Month" AS m, "Year" AS y FROM base),
kept AS (SELECT * FROM filled WHERE cap IS NOT NULL AND cap <> 'Subtotal'),
tbl AS (SELECT file, arg_min(struct_pack(year := {td.year_number_sql('y')}, month := {td.month_number_sql('m')}), row_idx) AS tp
        FROM kept WHERE {td.month_number_sql('m')} BETWEEN 1 AND 12 AND {td.year_number_sql('y')} BETWEEN 1900 AND 2100 GROUP BY file),
files AS (SELECT {fname} AS file, regexp_extract({fname}, '([^/\\\\]*)$', 1) AS filename,
          CASE WHEN n_nationkey % 4 > 1 THEN struct_pack(year := 2025, month := CAST((n_nationkey + 3) % 12 + 1 AS INTEGER)) END AS hp
          FROM nation),
p AS (SELECT f.file, f.filename, t.tp, {td.period_from_filename_sql('f.filename')} AS fp, f.hp FROM files f LEFT JOIN tbl t USING (file)),
n AS (SELECT *, {_notes_sql('tp', 'fp', 'hp')} AS notes FROM p)
SELECT file, filename, {td.format_period_sql('tp.year', 'tp.month')} AS canonical_period,
  {td.format_period_sql('fp.year', 'fp.month')} AS period_from_filename,
  {td.format_period_sql('hp.year', 'hp.month')} AS period_from_header,
  CAST(len(notes) AS INTEGER) AS n_notes, array_to_string(notes, ' / ') AS notes,
  'RLIP-only' AS file_type,
  'Omitted nuisance column at index 13: '''' | Omitted duplicate column at index 14: ''Taxes''' AS header_issues
FROM n"""


@register("report_metadata", _report_metadata_sql())
def q_report_metadata(spark, sf_dir):
    res, _, _ = _report(spark, sf_dir, "captive")
    m = res.metadata
    return m.select(
        "file", "filename", "canonical_period", "period_from_filename", "period_from_header",
        F.size("discrepancy_notes").cast("int").alias("n_notes"),
        F.array_join("discrepancy_notes", " / ").alias("notes"),
        "file_type",
        F.array_join("header_issues", " | ").alias("header_issues"),
    )


def _year_metadata_sql(family: str) -> str:
    """Metadata of the families whose period is the first valid year."""
    from ledgerfold.plans import layouts

    lay = layouts.LAYOUTS[family]()
    fname = layouts.file_name_sql(lay.file_prefix)
    year = td.year_number_sql('"Year"')
    return f"""WITH {layouts.base_sql(lay)},
tbl AS (SELECT file, arg_min(struct_pack(year := {year}, month := 1), row_idx) AS tp FROM base WHERE {year} BETWEEN 1900 AND 2100 GROUP BY file),
files AS (SELECT {fname} AS file, regexp_extract({fname}, '([^/\\\\]*)$', 1) AS filename,
          CASE WHEN n_nationkey % 4 > 1 THEN struct_pack(year := 2025, month := CAST((n_nationkey + 3) % 12 + 1 AS INTEGER)) END AS hp
          FROM nation),
p AS (SELECT f.file, f.filename, t.tp, {td.period_from_filename_sql('f.filename')} AS fp, f.hp FROM files f LEFT JOIN tbl t USING (file)),
n AS (SELECT *, {_notes_sql('tp', 'fp', 'hp')} AS notes FROM p)
SELECT file, filename, {td.format_period_sql('tp.year', 'tp.month')} AS canonical_period,
  {td.format_period_sql('fp.year', 'fp.month')} AS period_from_filename,
  {td.format_period_sql('hp.year', 'hp.month')} AS period_from_header,
  CAST(len(notes) AS INTEGER) AS n_notes, array_to_string(notes, ' / ') AS notes, 'combined' AS file_type FROM n"""


def _year_metadata(spark, sf_dir, family: str):
    return _report(spark, sf_dir, family)[0].metadata.select(
        "file", "filename", "canonical_period", "period_from_filename", "period_from_header",
        F.size("discrepancy_notes").cast("int").alias("n_notes"), F.array_join("discrepancy_notes", " / ").alias("notes"), "file_type",
    )


@register("report_metadata_commission", _year_metadata_sql("commission"))
def q_report_metadata_commission(spark, sf_dir):
    return _year_metadata(spark, sf_dir, "commission")


@register("report_metadata_referral", _year_metadata_sql("referral"))
def q_report_metadata_referral(spark, sf_dir):
    return _year_metadata(spark, sf_dir, "referral")


# ------------------------------------------------------------------ three-key consolidation on lineitem


def _supplier_rows(spark, sf_dir):
    from ledgerfold.llm.common import staged
    from ledgerfold.spec import MONTH_NAMES

    li = td.lineitem_rows(spark, sf_dir)
    sup = td.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    part = td.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    nation = F.broadcast(td.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    # The larger table first: if that join shuffles, rows have no names yet.
    j = (li.join(part, F.col("l_partkey") == F.col("p_partkey"))
         .join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
         .join(nation, F.col("s_nationkey") == F.col("n_nationkey")))
    # The fill reads its input twice: the lines and their names are written once, which also
    # lets go of the numbering's and the joins' shuffles before the wide rows are shuffled.
    j = staged(j.select("l_orderkey", "row_idx", "s_name", "n_name", "p_brand", "p_name", "l_shipdate", "l_extendedprice",
                        "l_quantity", "l_returnflag", "l_discount"), compression="zstd")
    k = F.col("row_idx")
    month = F.month("l_shipdate")
    cols = [
        F.concat(F.lit("file_"), F.expr("l_orderkey div 100").cast("string")).alias("file"), k,
        F.when(k % 3 == 1, F.lit(None)).when(k % 41 == 0, F.lit("Subtotal")).otherwise(F.col("s_name")).alias("Salesperson"),
        F.when(k % 5 == 2, F.lit(None)).otherwise(F.col("n_name")).alias("Captive Name"),
        F.col("p_brand").alias("Client Name (in POPIC)"),
    ]
    for i, m in enumerate(MONTH_NAMES, start=1):
        cols.append(F.when(month == i, td.money_text(F.col("l_extendedprice"), k % 5)).alias(f"{m} P&L"))
    for i, m in enumerate(MONTH_NAMES, start=1):
        cols.append(F.when(month == i, F.col("l_quantity").cast("string")).alias(f"{m} Commission"))
    cols += [
        td.signed_money_text(F.col("l_extendedprice") * F.when(k % 2 == 0, 1).otherwise(-1)).alias("Total"),
        F.year("l_shipdate").cast("string").alias("Year"),
        F.col("l_returnflag").alias("Income Type"),
        F.col("l_discount").cast("string").alias("Commission Rate"),
        F.col("p_name").alias("Account Name"),
    ]
    return j.select(*cols)


def _supplier_base_sql() -> str:
    from ledgerfold.spec import MONTH_NAMES

    cols = [
        "'file_' || CAST(l_orderkey // 100 AS VARCHAR) AS file", "row_idx",
        "CASE WHEN row_idx % 3 = 1 THEN NULL WHEN row_idx % 41 = 0 THEN 'Subtotal' ELSE s_name END AS \"Salesperson\"",
        "CASE WHEN row_idx % 5 = 2 THEN NULL ELSE n_name END AS \"Captive Name\"",
        "p_brand AS \"Client Name (in POPIC)\"",
    ]
    for i, m in enumerate(MONTH_NAMES, start=1):
        cols.append(f"CASE WHEN month(l_shipdate) = {i} THEN {td.money_text_sql('l_extendedprice', 'row_idx % 5')} END AS \"{m} P&L\"")
    for i, m in enumerate(MONTH_NAMES, start=1):
        cols.append(f"CASE WHEN month(l_shipdate) = {i} THEN CAST(l_quantity AS VARCHAR) END AS \"{m} Commission\"")
    cols += [
        td.signed_money_text_sql("(l_extendedprice * CASE WHEN row_idx % 2 = 0 THEN 1 ELSE -1 END)") + ' AS "Total"',
        'CAST(year(l_shipdate) AS VARCHAR) AS "Year"', 'l_returnflag AS "Income Type"',
        'CAST(l_discount AS VARCHAR) AS "Commission Rate"', 'p_name AS "Account Name"',
    ]
    return (td.LINEITEM_ROWS_SQL + ", base AS (SELECT " + ", ".join(cols) + " FROM lineitem_rows "
            "JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)")


def _consolidate_3key_sql() -> str:
    from ledgerfold.plans import layouts
    from ledgerfold.spec import COMMISSION_SPEC

    present = list(COMMISSION_SPEC.keys) + list(COMMISSION_SPEC.sums) + list(COMMISSION_SPEC.firsts)
    return layouts.consolidate_sql_from_base(_supplier_base_sql(), present, COMMISSION_SPEC, snake)


@register("consolidate_3key", _consolidate_3key_sql())
def q_consolidate_3key(spark, sf_dir):
    from ledgerfold.spec import COMMISSION_SPEC

    out = cons.consolidate(_supplier_rows(spark, sf_dir), COMMISSION_SPEC)
    return _round_doubles(_snake_all(out))


# ------------------------------------------------------------------ merge metadata


def _side_meta(spark, sf_dir, status: str, tag: str):
    from ledgerfold.functions.periods import discrepancy_notes, format_period, period

    d = _orders_dates(spark, sf_dir).join(
        td.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey"
    ).filter(F.col("o_orderstatus") == status)
    p = period(F.col("yy"), F.col("mm"))
    per = d.groupBy("o_custkey").agg(
        F.min_by(p, "o_orderkey").alias("tp"), F.max_by(p, "o_orderdate").alias("fp"), F.min_by(p, "o_orderdate").alias("hp"),
    )
    hp = F.when(F.col("o_custkey") % 3 == 0, F.lit(None)).otherwise(F.col("hp"))
    per = per.select("o_custkey", "tp", "fp", hp.alias("hp"))
    return per.select(
        "o_custkey",
        format_period("tp").alias("canonical_period"),
        format_period("fp").alias("period_from_filename"),
        format_period("hp").alias("period_from_header"),
        discrepancy_notes("tp", "fp", "hp").alias("discrepancy_notes"),
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string"), F.lit(f"_{tag}.xlsx")).alias("filename"),
    )


def _side_meta_sql(status: str, tag: str, name: str) -> str:
    per = (f"SELECT od.o_custkey, arg_min(struct_pack(year := CAST(yy AS INTEGER), month := CAST(mm AS INTEGER)), o_orderkey) AS tp, "
           f"arg_max(struct_pack(year := CAST(yy AS INTEGER), month := CAST(mm AS INTEGER)), o_orderdate) AS fp, "
           f"arg_min(struct_pack(year := CAST(yy AS INTEGER), month := CAST(mm AS INTEGER)), o_orderdate) AS hp0 "
           f"FROM od JOIN (SELECT o_orderkey AS ok2, o_orderstatus FROM orders) o ON o.ok2 = od.o_orderkey WHERE o.o_orderstatus = '{status}' GROUP BY od.o_custkey")
    return (f"{name}_p AS (SELECT o_custkey, tp, fp, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE hp0 END AS hp FROM ({per})), "
            f"{name} AS (SELECT o_custkey, {td.format_period_sql('tp.year', 'tp.month')} AS canonical_period, "
            f"{td.format_period_sql('fp.year', 'fp.month')} AS period_from_filename, "
            f"{td.format_period_sql('hp.year', 'hp.month')} AS period_from_header, "
            f"{_notes_sql('tp', 'fp', 'hp')} AS notes, 'cust_' || CAST(o_custkey AS VARCHAR) || '_{tag}.xlsx' AS filename FROM {name}_p)")


MERGE_META_SQL = ("WITH " + ORDERS_DATES_SQL + ", " + _side_meta_sql("F", "RLIP", "l") + ", " + _side_meta_sql("O", "RAP", "r") + """
SELECT o_custkey, l.canonical_period AS canonical_period,
  coalesce(l.period_from_filename, r.period_from_filename) AS period_from_filename,
  coalesce(l.period_from_header, r.period_from_header) AS period_from_header,
  array_to_string(list_concat(coalesce(l.notes, []), coalesce(r.notes, [])), ' / ') AS notes,
  'merged' AS file_type,
  array_to_string(list_filter([l.filename, r.filename], lambda x: x IS NOT NULL), ',') AS filenames
FROM l FULL JOIN r USING (o_custkey)""")


@register("merge_metadata", MERGE_META_SQL)
def q_merge_metadata(spark, sf_dir):
    from ledgerfold.operators.merge import merge_metadata

    left = _side_meta(spark, sf_dir, "F", "RLIP")
    right = _side_meta(spark, sf_dir, "O", "RAP")
    m = merge_metadata(left, right, ["o_custkey"])
    return m.select(
        "o_custkey", "canonical_period", "period_from_filename", "period_from_header",
        F.array_join("discrepancy_notes", " / ").alias("notes"), "file_type",
        F.array_join("filenames", ",").alias("filenames"),
    )


@register("merge_period_check", "WITH " + ORDERS_DATES_SQL + ", " + _side_meta_sql("F", "RLIP", "l") + ", "
          + _side_meta_sql("O", "RAP", "r") + """
SELECT o_custkey, (l.canonical_period IS NOT DISTINCT FROM r.canonical_period) AS ok,
  CASE WHEN l.canonical_period IS DISTINCT FROM r.canonical_period THEN
    'Cannot merge: RLIP file period is ' || coalesce(l.canonical_period, 'None') || ', RAP file period is '
    || coalesce(r.canonical_period, 'None') || '. Table month/year must match.' END AS error
FROM l FULL JOIN r USING (o_custkey)""")
def q_merge_period_check(spark, sf_dir):
    from ledgerfold.operators.merge import periods_match

    left = _side_meta(spark, sf_dir, "F", "RLIP")
    right = _side_meta(spark, sf_dir, "O", "RAP")
    return periods_match(left, right, on=["o_custkey"])


# ------------------------------------------------------------------ two report sets, merged


def _merged(spark, sf_dir):
    """The captive workbooks as RLIP set; as RAP set the same workbooks with the
    fee's header renamed and, in every fourth file name length, another year."""
    from ledgerfold.plans import layouts
    from ledgerfold.plans.merged import merge_ingested
    from ledgerfold.plans.reports import ingest

    left_rows = layouts.build_rows(spark, sf_dir, layouts.captive_layout())
    right_rows = left_rows.select(
        F.regexp_replace("file", "^captive/", "rap/").alias("file"), "row_idx",
        F.transform("values", lambda v: F.when(v == "POPIC Fee RLIP", F.lit("POPIC Fee RAP"))
                    .when((v == "2025") & (F.length("file") % 4 == 0), F.lit("2024")).otherwise(v)).alias("values"),
    )
    left = ingest(left_rows, CAPTIVE_SPEC, block_rows=1 << 12, stage_rows=True)
    right = ingest(right_rows, CAPTIVE_SPEC, block_rows=1 << 12, stage_rows=True)
    names = td.table(spark, sf_dir, "nation").select(layouts.file_name_spark("").alias("pair"))
    pairs = names.select("pair", F.concat(F.lit("captive/"), "pair").alias("left_file"), F.concat(F.lit("rap/"), "pair").alias("right_file"))
    lost = spark.range(1).select(F.lit("lost").alias("pair"), F.lit("captive/lost").alias("left_file"), F.lit("rap/lost").alias("right_file"))
    return merge_ingested(left, right, pairs.unionByName(lost), CAPTIVE_SPEC)


def _merged_columns() -> list[str]:
    from ledgerfold.plans import layouts

    return layouts.output_columns(layouts.captive_layout(), CAPTIVE_SPEC) + ["POPIC Fee RAP"]


def _merged_sql() -> str:
    """Both halves carry the same values: measures double, first values and the
    two fees come from one side each."""
    keys = [snake(k) for k in CAPTIVE_SPEC.keys]
    out = []
    for c in _merged_columns():
        n = snake(c)
        if n in keys or c in CAPTIVE_SPEC.firsts or "RLIP" in c:
            out.append(n if n in keys else f"coalesce({n}, 0.0) AS {n}")
        elif c == "POPIC Fee RAP":
            out.append(f"coalesce(popic_fee_rlip, 0.0) AS {n}")
        else:
            out.append(f"round(2 * coalesce({n}, 0.0), 2) AS {n}")
    return ("SELECT substr(file, 9) AS pair, " + ", ".join(out) + " FROM (" + _report_sql("captive") + ") WHERE length(file) % 4 <> 0")


@register("merge_report_end_to_end", _merged_sql())
def q_merge_report_end_to_end(spark, sf_dir):
    return _round_doubles(_snake_all(_merged(spark, sf_dir).data.select("pair", *_merged_columns())))


@register("merge_report_status", "WITH m AS (" + _report_metadata_sql() + """)
SELECT substr(file, 9) AS pair, CASE WHEN length(file) % 4 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN length(file) % 4 = 0 THEN 'Cannot merge: RLIP file period is ' || canonical_period || ', RAP file period is '
    || replace(canonical_period, '2025', '2024') || '. Table month/year must match.' END AS error FROM m
UNION ALL SELECT 'lost', 'error', 'RLIP file: The file was not read.'""")
def q_merge_report_status(spark, sf_dir):
    return _merged(spark, sf_dir).status


@register("merge_report_metadata", "WITH m AS (" + _report_metadata_sql() + """)
SELECT substr(file, 9) AS pair, canonical_period, period_from_filename, period_from_header, 'merged' AS file_type,
  filename || ',' || filename AS filenames FROM m WHERE length(file) % 4 <> 0""")
def q_merge_report_metadata(spark, sf_dir):
    m = _merged(spark, sf_dir).metadata
    return m.select("pair", "canonical_period", "period_from_filename", "period_from_header", "file_type", F.array_join("filenames", ",").alias("filenames"))


# ------------------------------------------------------------------ typed read, key order


@register("records_source", """
WITH c AS (SELECT *, c_custkey // 100 AS body_id, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) - 1 AS row_idx FROM customer),
b AS (SELECT body_id, count(*) AS n FROM c GROUP BY 1),
s AS (SELECT body_id, CASE WHEN body_id % 7 IN (1, 2, 5) THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN body_id % 7 IN (1, 2) THEN 'Request body must have ''data'' (array) and ''columns'' (array).' WHEN body_id % 7 = 5 THEN 'Request body must be a JSON object.' END AS error,
  CASE WHEN body_id % 7 IN (3, 4) THEN 0 WHEN body_id % 7 IN (0, 6) THEN n END AS total_rows, CASE WHEN body_id % 7 IN (0, 3, 4, 6) THEN 3 END AS n_columns FROM b)
SELECT s.body_id, status, error, total_rows, n_columns, CAST(row_idx AS BIGINT) AS row_idx, c_custkey,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS "Balance $", c_mktsegment AS segment
FROM s LEFT JOIN c ON c.body_id = s.body_id AND s.body_id % 7 IN (0, 6)""")
def q_records_source(spark, sf_dir):
    """Bodies of a hundred customers; some have data or columns of another kind, none, or are no JSON."""
    from ledgerfold.sources.records import read_records, typed

    c = td.table(spark, sf_dir, "customer").withColumn("body_id", F.floor(F.col("c_custkey") / 100))
    balance = F.when(F.col("c_custkey") % 3 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string"))
    record = F.struct("c_custkey", balance.alias("Balance $"), F.struct(F.col("c_mktsegment").alias("segment")).alias("more"))
    made = c.groupBy("body_id").agg(F.to_json(F.array_sort(F.collect_list(record))).alias("data"))
    kind, names = F.col("body_id") % 7, F.lit('["c_custkey", "Balance $", "more"]')
    data = F.when(kind == 1, F.lit('{"a": 1}')).when(kind == 4, F.lit("null")).otherwise(F.col("data"))
    body = F.concat(F.lit('{"data": '), data, F.lit(', "columns": '), F.when(kind == 2, F.lit('"all"')).otherwise(names), F.lit("}"))
    body = F.when(kind == 3, F.concat(F.lit('{"columns": '), names, F.lit("}"))).when(kind == 5, F.lit("{data: [")).otherwise(body)
    read = read_records(made.select("body_id", body.alias("body")))
    rows = typed(read.rows, {"c_custkey": "bigint", "Balance $": "double", "more": "struct<segment:string>"})
    rows = rows.select("body_id", "row_idx", "c_custkey", "Balance $", F.col("more.segment").alias("segment"))
    return read.status.join(rows, "body_id", "left")


@register("typed_read", """
SELECT c_custkey AS row_idx, c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS "Balance",
  strftime(CAST('2025-01-01' AS DATE) + CAST(c_custkey % 300 AS INTEGER), '%Y-%m-%d') AS "Day", 'date' AS "Day type", c_custkey % 2 = 0 AS "Even", c_mktsegment AS "Segment",
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 11 AS VARCHAR) || 'x' END AS "Segment_2"
FROM customer WHERE c_custkey > 0""")
def q_typed_read(spark, sf_dir):
    from ledgerfold.sources.typed import typed_read

    c = td.table(spark, sf_dir, "customer").filter("c_custkey > 0")
    k = F.col("c_custkey")
    body = c.select(k.alias("row_idx"), F.array(
        k.cast("string"), F.when(k % 5 == 0, F.lit("NaN")).otherwise(F.concat(F.col("c_acctbal").cast("string"), F.lit("\t"))),
        F.date_add(F.lit("2025-01-01").cast("date"), (k % 300).cast("int")).cast("string"),
        F.when(k % 2 == 0, "TRUE").otherwise("false"), F.col("c_mktsegment"),
        F.when(k % 7 == 0, "").otherwise(F.concat((k % 11).cast("string"), F.lit("x"))),
    ).alias("values"))
    header = spark.range(1).select(F.lit(0).cast("long").alias("row_idx"), F.array(*[F.lit(x) for x in ("id", " Balance", "Day", "Even", "Segment", "Segment")]).alias("values"))
    out = typed_read(header.unionByName(body))
    return out.withColumns({"Day type": F.typeof("Day"), "Day": F.col("Day").cast("string")})


@register("report_key_order", "WITH d AS (" + _report_sql("captive") + """)
SELECT file, captive_name_captive_name, captive_name_client,
  row_number() OVER (PARTITION BY file ORDER BY captive_name_captive_name, captive_name_client) AS rank FROM d""")
def q_report_key_order(spark, sf_dir):
    from ledgerfold.operators.ranks import Ranked

    res, _, _ = _report(spark, sf_dir, "captive")
    keys = list(CAPTIVE_SPEC.keys)
    whole = Ranked(res.data.select("file", *keys), [F.col("file"), *[F.col(k) for k in keys]]).with_rank("__all")
    first = whole.groupBy("file").agg(F.min("__all").alias("__first"))
    return _snake_all(whole.join(first, "file").select("file", *keys, (F.col("__all") - F.col("__first") + 1).alias("rank")))


# ------------------------------------------------------------------ charts over consolidated reports


LABEL_SQL = """CASE WHEN trim(captive_name_client) <> '' THEN trim(captive_name_captive_name) || ' | ' || trim(captive_name_client)
               ELSE trim(captive_name_captive_name) END"""


def _entities_sql(source: str, lead: str, value: str, agg: str) -> str:
    order = f"({lead}, captive_name_captive_name, captive_name_client)"
    return f"""WITH d AS ({source}),
e AS (SELECT {LABEL_SQL} AS label, {agg.format(v=value, o=order)} AS value, min({order}) AS first_row
      FROM d WHERE {value} IS NOT NULL GROUP BY 1 HAVING label <> '')"""


def _top_sql(source: str, lead: str, value: str, n: int, agg: str = "sum({v})") -> str:
    return _entities_sql(source, lead, value, agg) + f"""
SELECT CAST(row_number() OVER (ORDER BY value DESC, first_row) AS INTEGER) AS rank, label, round(value, 2) AS value
FROM e ORDER BY value DESC, first_row LIMIT {n}"""


def _pie_sql(source: str, lead: str, value: str) -> str:
    return _entities_sql(source, lead, value, "sum({v})") + """,
ranked AS (SELECT *, row_number() OVER (ORDER BY value DESC, first_row) AS rn FROM e),
tot AS (SELECT sum(value) AS total, sum(value) FILTER (WHERE rn > 4) AS rest FROM ranked),
slices AS (SELECT CAST(rn AS INTEGER) AS rank, label, value FROM ranked WHERE rn <= 4 UNION ALL SELECT 5, 'Others', rest FROM tot WHERE rest > 0)
SELECT rank, label, round(value, 2) AS value, round(100.0 * value / total, 2) AS percent FROM slices, tot WHERE total <> 0"""


def _chart(data: DataFrame, name: str) -> DataFrame:
    from ledgerfold.plans.charts import CHARTS

    out = CHARTS[name](data)
    return out.withColumn("value", F.round("value", 2))


@register("report_top_rent", _top_sql(_report_sql("captive"), "file", "additional_rent", 7))
def q_report_top_rent(spark, sf_dir):
    # The measure arrives under an alias of its canonical name.
    return _chart(_report(spark, sf_dir, "captive")[0].data.withColumnRenamed("Additional Rent", "ADTL RENT"), "top_rent")


@register("report_top_units", _top_sql(_report_sql("captive"), "file", "total_available_units", 5, "arg_min({v}, {o})"))
def q_report_top_units(spark, sf_dir):
    return _chart(_report(spark, sf_dir, "captive")[0].data, "top_units")


@register("report_fee_rlip", _pie_sql(_report_sql("captive"), "file", "popic_fee_rlip"))
def q_report_fee_rlip(spark, sf_dir):
    return _chart(_report(spark, sf_dir, "captive")[0].data, "fee_rlip")


@register("report_fee_rap", _pie_sql(_merged_sql(), "pair", "popic_fee_rap"))
def q_report_fee_rap(spark, sf_dir):
    return _chart(_merged(spark, sf_dir).data, "fee_rap")


def _file_chart_sql(chart: str, value: str, n: int, agg: str = "sum(v)", others: bool = False) -> str:
    """Charts of every file of d2; with ``others`` the rest as a last slice, and percents."""
    ranked = f"""(SELECT *, row_number() OVER (PARTITION BY file ORDER BY value DESC, first_row) AS rn,
      sum(value) OVER (PARTITION BY file) AS total FROM (
      SELECT file, {LABEL_SQL} AS label, {agg.replace('v', value, 1) if agg.startswith('sum') else agg} AS value, min((captive_name_captive_name, captive_name_client)) AS first_row
      FROM d2 WHERE {value} IS NOT NULL GROUP BY file, label HAVING label <> ''))"""
    if not others:
        return f"SELECT file, '{chart}' AS chart, rn AS rank, label, value, NULL::DOUBLE AS percent FROM {ranked} WHERE rn <= {n}"
    slices = f"""SELECT file, rn AS rank, label, value, total FROM {ranked} WHERE rn <= {n} UNION ALL
      SELECT file, {n + 1}, 'Others', sum(value), any_value(total) FROM {ranked} WHERE rn > {n} GROUP BY file HAVING sum(value) > 0"""
    return f"SELECT file, '{chart}' AS chart, rank, label, value, round(100.0 * value / total, 2) AS percent FROM ({slices}) WHERE total <> 0"


def _chart_cache_sql() -> str:
    first = "arg_min(total_available_units, (captive_name_captive_name, captive_name_client))"
    return f"""WITH d AS ({_report_sql("captive")}),
d2 AS (SELECT * REPLACE (CASE WHEN length(file) % 3 = 0 THEN additional_rent + 1000 ELSE additional_rent END AS additional_rent) FROM d),
c AS ({_file_chart_sql("top_rent", "additional_rent", 7)}
  UNION ALL {_file_chart_sql("top_units", "total_available_units", 5, first)}
  UNION ALL {_file_chart_sql("fee_rlip", "popic_fee_rlip", 4, others=True)}),
changed AS (SELECT file, bool_or(length(file) % 3 = 0 AND additional_rent IS NOT NULL) AS changed FROM d GROUP BY file)
SELECT file, CASE WHEN changed THEN 'miss' ELSE 'hit' END AS state, chart, CAST(rank AS INTEGER) AS rank, label, round(value, 2) AS value, percent
FROM c JOIN changed USING (file)
UNION ALL SELECT file, 'cleared', '', 0, NULL, 0, NULL FROM changed WHERE changed"""


@register("chart_cache", _chart_cache_sql())
def q_chart_cache(spark, sf_dir):
    """Charts of all files are stored; then every file is looked up again, its rows in
    another order, a third of the files with other rents; what the old rents gave is cleared."""
    import os
    import uuid

    from ledgerfold.plans.chart_cache import ChartCache, fingerprints
    from ledgerfold.session import checkpoint_dir, materialize

    data = materialize(_report(spark, sf_dir, "captive")[0].data)
    cache = ChartCache(spark, os.path.join(checkpoint_dir(spark), "charts", uuid.uuid4().hex))
    order = F.struct(*CAPTIVE_SPEC.keys)
    before, _ = cache.tables(data, order)
    rent = F.when(F.length("file") % 3 == 0, F.col("Additional Rent") + 1000).otherwise(F.col("Additional Rent"))
    again = data.withColumn("Additional Rent", rent).orderBy(F.desc(CAPTIVE_SPEC.keys[0]))
    states, charts = cache.tables(again, order)
    charts = materialize(charts)
    dropped = cache.keep_only(fingerprints(again, version=cache.version))
    now = states.select("file", "state").join(charts, "file").withColumn("value", F.round("value", 2))
    gone = before.join(dropped, "key").join(cache.entries().groupBy("key").count(), "key", "left").select(
        "file", F.lit("cleared").alias("state"), F.lit("").alias("chart"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("label"),
        F.coalesce("count", F.lit(0)).cast("double").alias("value"), F.lit(None).cast("double").alias("percent"))
    return now.select(*gone.columns).unionByName(gone)


_ARRIVED_SQL = """d AS (SELECT n_name AS file, c_mktsegment AS captive, left(c_name, 17) AS client, c_custkey AS k, c_acctbal AS v, c_custkey % 12 + 1 AS m, c_nationkey AS nation
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
now AS (SELECT file, captive, client, k, CASE WHEN nation % 3 = 0 THEN v + 100 ELSE v END AS v, m FROM d WHERE nation % 3 <> 0 OR k % 2 = 0)"""


def _arrived(spark, sf_dir):
    """Customers as report rows: a file for each nation; k is the row's place."""
    c = td.table(spark, sf_dir, "customer").join(td.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("n_name").alias("file"), F.col("c_mktsegment").alias("captive"), F.left("c_name", F.lit(17)).alias("client"), F.col("c_custkey").alias("k"),
                    F.col("c_acctbal").alias("v"), (F.col("c_custkey") % 12 + 1).alias("m"), F.col("c_nationkey").alias("nation"))


def _published(spark, sf_dir, tables):
    """All files are published; then a third of them come again with other rows."""
    import os
    import uuid

    from ledgerfold.plans.publish import Publication
    from ledgerfold.session import checkpoint_dir

    out = Publication(spark, os.path.join(checkpoint_dir(spark), "published", uuid.uuid4().hex))
    rows = _arrived(spark, sf_dir)
    out.publish(tables(rows), rows.select("file"))
    again = rows.filter("nation % 3 = 0 AND k % 2 = 0").withColumn("v", F.col("v") + 100)
    out.publish(tables(again), rows.filter("nation % 3 = 0").select("file"))
    return out


@register("published_tables", "WITH " + _ARRIVED_SQL + """, s AS (SELECT file, count(*) AS n, round(sum(v), 2) AS v FROM now GROUP BY file)
SELECT 'data' AS part, file, k AS n, round(v, 2) AS v FROM now UNION ALL SELECT 'status', file, n, v FROM s""")
def q_published_tables(spark, sf_dir):
    def tables(rows):
        return {"data": rows.select("file", "k", "v"), "status": rows.groupBy("file").agg(F.count("*").alias("n"), F.sum("v").alias("v"))}

    out = _published(spark, sf_dir, tables)
    version = out.version()
    data = out.read("data", version).select(F.lit("data").alias("part"), "file", F.col("k").alias("n"), F.round("v", 2).alias("v"))
    return data.unionByName(out.read("status", version).select(F.lit("status").alias("part"), "file", "n", F.round("v", 2).alias("v")))


@register("merged_states", "WITH " + _ARRIVED_SQL + """,
e AS (SELECT captive || ' | ' || trim(client) AS label, sum(v) AS total, arg_min(v, (file, k)) AS first_value, min((file, k)) AS first_row FROM now GROUP BY 1),
t AS (SELECT 'top' AS chart, row_number() OVER (ORDER BY total DESC, first_row) AS rank, label, round(total, 2) AS value FROM e),
f AS (SELECT 'first' AS chart, row_number() OVER (ORDER BY first_value DESC, first_row) AS rank, label, round(first_value, 2) AS value FROM e)
SELECT chart, CAST(rank AS INTEGER) AS rank, label, value FROM t WHERE rank <= 7
UNION ALL SELECT chart, CAST(rank AS INTEGER), label, value FROM f WHERE rank <= 5
UNION ALL SELECT 'months', CAST(m AS INTEGER), ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'][m], round(sum(v), 2) FROM now GROUP BY m""")
def q_merged_states(spark, sf_dir):
    """Charts over all files from their stored states, after a third of the files were replaced."""
    from ledgerfold.operators import chart_states as C

    months = [f"m{i}" for i in range(1, 13)]

    def tables(rows):
        wide = rows.withColumns({name: F.when(F.col("m") == i, F.col("v")) for i, name in enumerate(months, 1)})
        return {"entities": C.entity_states(rows, ["v"], "captive", "client", F.col("k")), "months": C.month_states(wide, months)}

    out = _published(spark, sf_dir, tables)
    version = out.version()
    merged = C.merge_entities(out.read("entities", version))
    top = C.top_of(merged, "v", 7).select(F.lit("top").alias("chart"), "rank", "label", "value")
    first = C.top_of(merged, "v", 5, take_first=True).select(F.lit("first").alias("chart"), "rank", "label", "value")
    by_month = C.merge_months(out.read("months", version)).select(F.lit("months").alias("chart"), F.col("month_idx").alias("rank"), F.col("month").alias("label"), "value")
    return top.unionByName(first).unionByName(by_month).withColumn("value", F.round("value", 2))


@register("report_fee_share", "WITH d AS (" + _merged_sql() + """), t AS (SELECT sum(popic_fee_rlip) AS a, sum(popic_fee_rap) AS b FROM d)
SELECT 1 AS rank, 'POPIC Fee RLIP' AS label, round(a, 2) AS value, CASE WHEN a + b = 0 THEN 0.0 ELSE round(100.0 * a / (a + b), 2) END AS percent FROM t
UNION ALL SELECT 2, 'POPIC Fee RAP', round(b, 2), CASE WHEN a + b = 0 THEN 0.0 ELSE round(100.0 * b / (a + b), 2) END FROM t""")
def q_report_fee_share(spark, sf_dir):
    return _chart(_merged(spark, sf_dir).data, "fee_share")


def _monthly_sql(columns) -> str:
    from ledgerfold.spec import MONTH_NAMES

    parts = " UNION ALL ".join(
        f"SELECT {i} AS month_idx, '{MONTH_NAMES[i - 1]}' AS month, round(coalesce(sum({snake(c)}), 0.0), 2) AS value FROM d"
        for i, c in enumerate(columns, start=1)
    )
    return "WITH d AS (" + _report_sql("commission") + ") " + parts


@register("report_monthly_commission", _monthly_sql(COMMISSION_COMMISSION))
def q_report_monthly_commission(spark, sf_dir):
    return _chart(_report(spark, sf_dir, "commission")[0].data, "monthly_commission")


@register("report_monthly_pnl", _monthly_sql(COMMISSION_PNL))
def q_report_monthly_pnl(spark, sf_dir):
    return _chart(_report(spark, sf_dir, "commission")[0].data, "monthly_pnl")
