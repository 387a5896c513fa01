"""Report workbooks laid out from the supplied tables (rows form), and the SQL
oracle of their consolidation.

One file per nation.  Each file has ``n_nationkey % 4`` title rows, a header
row (with misspelt, arrowed, blank and duplicate headers), then one data row
per source record with ``row_idx = start + 1 + record key``.  Row indexes
need not be dense; only their order matters.

The Spark side builds the rows table and runs the full ingestion
(:func:`ledgerfold.plans.reports.ingest`): table discovery, header mapping,
gates, promotion, fill, filter, parse, group.  The oracle knows the intended
header mapping and computes the consolidation directly from the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.plans import testdata as td
from ledgerfold.spec import MONTH_NAMES, ReportSpec


@dataclass(frozen=True)
class Col:
    """One workbook column.  Spark parts are zero-argument callables so that the
    SQL side (the oracle) can be built without a running Spark session."""

    header_spark: object  # () -> Column
    header_sql: str
    canonical: str | None  # intended mapping; None for dropped columns
    value_spark: object  # () -> Column
    value_sql: str


@dataclass(frozen=True)
class Layout:
    name: str
    source: str  # "customer" or "orders"
    columns: tuple
    file_prefix: str


def _nat_case(opts, mod):
    """Header text chosen by nation key modulo ``mod``."""
    def spark():
        k = F.col("n_nationkey") % mod
        e = None
        for i, v in enumerate(opts):
            e = F.when(k == i, F.lit(v)) if e is None else e.when(k == i, F.lit(v))
        return e

    sql = "CASE n_nationkey % {m} {w} END".format(m=mod, w=" ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(opts)))
    return spark, sql


def _lit(h):
    return (lambda: F.lit(h)), f"'{h}'"


def _month_text_spark(m: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in MONTH_NAMES]), m.cast("int"))


def _month_text_sql(m: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in MONTH_NAMES) + f"][{m}]"


def _c(name):
    return F.col(name)


# ------------------------------------------------------------------ captive


def captive_layout() -> Layout:
    def k():
        return F.col("c_custkey")

    cols = [
        Col(*_nat_case(["Captive Name: Captive Name", "captive Name: captive name", "Captiev Name: Captive Name #!"], 3),
            "Captive Name: Captive Name",
            lambda: F.when(k() % 6 == 1, F.lit(None)).when(k() % 37 == 0, F.lit("Subtotal")).otherwise(_c("c_mktsegment")),
            "CASE WHEN c_custkey % 6 = 1 THEN NULL WHEN c_custkey % 37 = 0 THEN 'Subtotal' ELSE c_mktsegment END"),
        Col(*_lit("Captive Name: Client"), "Captive Name: Client",
            lambda: F.when(k() % 4 == 0, F.lit("Client A")).when(k() % 4 == 1, F.lit("Client B"))
            .when(k() % 4 == 2, F.lit(None)).otherwise(F.lit("Client C")),
            "CASE c_custkey % 4 WHEN 0 THEN 'Client A' WHEN 1 THEN 'Client B' WHEN 2 THEN NULL ELSE 'Client C' END"),
        Col(*_lit("Gross Written Premium ↑"), "Gross Written Premium",
            lambda: td.money_text(_c("c_acctbal"), k() % 5), td.money_text_sql("c_acctbal", "c_custkey % 5")),
        Col(*_lit("Taxes"), "Taxes", lambda: (k() % 100).cast("string"), "CAST(c_custkey % 100 AS VARCHAR)"),
        Col(*_lit("ADDITIONAL RENT"), "Additional Rent", lambda: td.signed_money_text(_c("c_acctbal")),
            td.signed_money_text_sql("c_acctbal")),
        Col(*_lit("Retained At Property"), "Retained At Property", lambda: _c("c_nationkey").cast("string"),
            "CAST(c_nationkey AS VARCHAR)"),
        Col(*_lit("Credit Card Fees"), "Credit Card Fees", lambda: F.concat((k() % 7).cast("string"), F.lit(".25")),
            "CAST(c_custkey % 7 AS VARCHAR) || '.25'"),
        Col(*_lit("Administrative  Fees"), "Administrative Fees",
            lambda: F.concat(F.lit("($"), (k() % 13).cast("string"), F.lit(")")),
            "'($' || CAST(c_custkey % 13 AS VARCHAR) || ')'"),
        Col(*_lit("Net Income"), "Net Income",
            lambda: F.when(k() % 2 == 0, F.lit("12%")).otherwise(_c("c_acctbal").cast("string")),
            "CASE WHEN c_custkey % 2 = 0 THEN '12%' ELSE CAST(c_acctbal AS VARCHAR) END"),
        Col(*_lit("Total Available Units"), "Total Available Units",
            lambda: F.when(k() % 10 == 3, F.lit(None)).otherwise((k() % 50).cast("string")),
            "CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE CAST(c_custkey % 50 AS VARCHAR) END"),
        Col(*_lit("POPIC Fee RLIP"), "POPIC Fee RLIP",
            lambda: td.money_text(_c("c_acctbal"), (k() / 5).cast("long") % 5),
            td.money_text_sql("c_acctbal", "(c_custkey // 5) % 5")),
        Col(*_lit("Month"), "Month", lambda: _month_text_spark(k() % 12 + 1), _month_text_sql("c_custkey % 12 + 1")),
        Col(*_lit("Year"), "Year", lambda: F.lit("2025"), "'2025'"),
        Col(*_lit(""), None, lambda: F.lit("junk"), "'junk'"),
        Col(*_lit("Taxes"), None, lambda: F.lit("999"), "'999'"),
    ]
    return Layout("captive", "customer", tuple(cols), "captive/")


# ------------------------------------------------------------------ commission / referral (orders rows)


def commission_layout() -> Layout:
    def k():
        return F.col("o_orderkey")

    def month():
        return F.month("o_orderdate")

    cols = [
        Col(*_nat_case(["Salesperson", "Sales Person", "salesperson ↑"], 3), "Salesperson",
            lambda: F.when(k() % 4 == 1, F.lit(None)).when(k() % 31 == 0, F.lit("SUBTOTAL")).when(k() % 43 == 0, F.lit("Total"))
            .otherwise(F.concat(F.lit("Rep "), (_c("o_custkey") % 9).cast("string"))),
            "CASE WHEN o_orderkey % 4 = 1 THEN NULL WHEN o_orderkey % 31 = 0 THEN 'SUBTOTAL' WHEN o_orderkey % 43 = 0 THEN 'Total' "
            "ELSE 'Rep ' || CAST(o_custkey % 9 AS VARCHAR) END"),
        Col(*_lit("Captive Name"), "Captive Name",
            lambda: F.when(k() % 5 == 2, F.lit(None)).otherwise(_c("c_mktsegment")),
            "CASE WHEN o_orderkey % 5 = 2 THEN NULL ELSE c_mktsegment END"),
        Col(*_nat_case(["Client Name (in POPIC)", "Client Name", "client name (in popic)"], 3), "Client Name (in POPIC)",
            lambda: _c("o_orderpriority"), "o_orderpriority"),
    ]
    for i, m in enumerate(MONTH_NAMES, start=1):
        cols.append(Col(*_lit(f"{m} P&L"), f"{m} P&L",
                        lambda i=i: F.when(month() == i, td.signed_money_text(_c("o_totalprice"))),
                        f"CASE WHEN month(o_orderdate) = {i} THEN {td.signed_money_text_sql('o_totalprice')} END"))
    for i, m in enumerate(MONTH_NAMES, start=1):
        cols.append(Col(*_lit(f"{m} Commission"), f"{m} Commission",
                        lambda i=i: F.when(month() == i, (_c("o_custkey") % 100).cast("string")),
                        f"CASE WHEN month(o_orderdate) = {i} THEN CAST(o_custkey % 100 AS VARCHAR) END"))
    cols += [
        Col(*_lit("Total"), "Total", lambda: td.money_text(_c("o_totalprice"), k() % 5),
            td.money_text_sql("o_totalprice", "o_orderkey % 5")),
        Col(*_lit("Year"), "Year", lambda: F.when(k() % 3 == 0, F.lit(None)).otherwise(F.year("o_orderdate").cast("string")),
            "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS VARCHAR) END"),
        Col(*_lit("Income Type"), "Income Type", lambda: _c("o_orderstatus"), "o_orderstatus"),
        Col(*_lit("Commission Rate"), "Commission Rate", lambda: F.lit("5%"), "'5%'"),
        Col(*_lit("Account Name"), "Account Name", lambda: _c("c_name"), "c_name"),
    ]
    return Layout("commission", "orders", tuple(cols), "commission/")


def referral_layout() -> Layout:
    def k():
        return F.col("o_orderkey")

    def month():
        return F.month("o_orderdate")

    cols = [
        Col(*_lit("Vendor Name"), "Vendor",
            lambda: F.when(k() % 3 == 1, F.lit(None)).when(k() % 29 == 0, F.lit("count"))
            .otherwise(F.concat(F.lit("Vendor "), (_c("o_custkey") % 7).cast("string"))),
            "CASE WHEN o_orderkey % 3 = 1 THEN NULL WHEN o_orderkey % 29 = 0 THEN 'count' "
            "ELSE 'Vendor ' || CAST(o_custkey % 7 AS VARCHAR) END"),
        Col(*_lit("Captive Name"), "Captive Name",
            lambda: F.when(k() % 7 == 2, F.lit(None)).otherwise(_c("c_mktsegment")),
            "CASE WHEN o_orderkey % 7 = 2 THEN NULL ELSE c_mktsegment END"),
    ]
    for i, m in enumerate(MONTH_NAMES, start=1):
        cols.append(Col(*_lit(m), m, lambda i=i: F.when(month() == i, td.money_text(_c("o_totalprice"), k() % 5)),
                        f"CASE WHEN month(o_orderdate) = {i} THEN {td.money_text_sql('o_totalprice', 'o_orderkey % 5')} END"))
    cols += [
        Col(*_lit("POPIC Fee"), "POPIC Fee", lambda: (_c("o_custkey") % 100).cast("string"), "CAST(o_custkey % 100 AS VARCHAR)"),
        Col(*_lit("Year"), "Year", lambda: F.year("o_orderdate").cast("string"), "CAST(year(o_orderdate) AS VARCHAR)"),
        Col(*_lit("Referral Fee %"), "Referral Fee %", lambda: F.lit("10%"), "'10%'"),
    ]
    return Layout("referral", "orders", tuple(cols), "referral/")


LAYOUTS = {"captive": captive_layout, "commission": commission_layout, "referral": referral_layout}


# ------------------------------------------------------------------ Spark rows table


def _source(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    nation = F.broadcast(td.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    cust = td.table(spark, sf_dir, "customer")
    if source == "customer":
        return cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("rec", F.col("c_custkey"))
    orders = td.table(spark, sf_dir, "orders")
    return (
        orders.join(cust.select("c_custkey", "c_nationkey", "c_mktsegment", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("rec", F.col("o_orderkey"))
    )


def file_name_spark(prefix: str) -> Column:
    m = F.col("n_nationkey") % 12 + 1
    return F.concat(F.lit(prefix), F.col("n_name"), F.lit("_"), _month_text_spark(m), F.lit(" 2025.xlsx"))


def file_name_sql(prefix: str) -> str:
    return f"'{prefix}' || n_name || '_' || {_month_text_sql('n_nationkey % 12 + 1')} || ' 2025.xlsx'"


def title_rows(nation: DataFrame, prefix: str) -> DataFrame:
    """Up to three title rows per file (``n_nationkey % 4`` of them)."""
    t = F.col("n_nationkey") % 4
    null = F.lit(None).cast("string")
    rows = F.array(
        F.struct(F.lit(0).cast("long").alias("row_idx"), F.array(F.lit("Report Summary"), null).alias("values")),
        F.struct(F.lit(1).cast("long").alias("row_idx"),
                 F.array(null, F.concat(F.lit("Report period: 2025/"), ((F.col("n_nationkey") + 3) % 12 + 1).cast("string"))).alias("values")),
        F.struct(F.lit(2).cast("long").alias("row_idx"), F.array(F.concat(F.lit("Prepared for "), F.col("n_name")), F.lit("  ")).alias("values")),
    )
    ex = nation.select(file_name_spark(prefix).alias("file"), t.alias("t"), F.inline(rows))
    return ex.filter(F.col("row_idx") < F.col("t")).select("file", "row_idx", "values")


def build_rows(spark: SparkSession, sf_dir: str, layout: Layout) -> DataFrame:
    """The rows table ``(file, row_idx, values)`` of the layout's workbooks."""
    nation = td.table(spark, sf_dir, "nation")
    t = (F.col("n_nationkey") % 4).cast("long")
    header = nation.select(
        file_name_spark(layout.file_prefix).alias("file"), t.alias("row_idx"),
        F.array(*[c.header_spark() for c in layout.columns]).alias("values"),
    )
    src = _source(spark, sf_dir, layout.source)
    data = src.select(
        file_name_spark(layout.file_prefix).alias("file"), (t + 1 + F.col("rec")).alias("row_idx"),
        F.array(*[c.value_spark().cast("string") for c in layout.columns]).alias("values"),
    )
    return title_rows(nation, layout.file_prefix).unionByName(header).unionByName(data)


# ------------------------------------------------------------------ SQL oracle


def _source_sql(source: str) -> str:
    if source == "customer":
        return "customer JOIN nation ON c_nationkey = n_nationkey"
    return ("orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")


def _rec_sql(source: str) -> str:
    return "c_custkey" if source == "customer" else "o_orderkey"


def base_sql(layout: Layout) -> str:
    """CTE ``base``: data rows with intended canonical columns."""
    seen = set()
    cols = []
    for c in layout.columns:
        if c.canonical and c.canonical not in seen:
            seen.add(c.canonical)
            cols.append(f'{c.value_sql} AS "{c.canonical}"')
    return (
        f"base AS (SELECT {file_name_sql(layout.file_prefix)} AS file, "
        f"n_nationkey % 4 + 1 + {_rec_sql(layout.source)} AS row_idx, " + ", ".join(cols)
        + f" FROM {_source_sql(layout.source)})"
    )


def consolidate_sql(layout: Layout, spec: ReportSpec, snake) -> str:
    """Oracle of ``ingest(...).data`` for the layout: fill, filter, parse, group."""
    present = list(dict.fromkeys(c.canonical for c in layout.columns if c.canonical))
    return consolidate_sql_from_base(base_sql(layout), present, spec, snake)


def consolidate_sql_from_base(base_cte: str, present, spec: ReportSpec, snake) -> str:
    """SQL consolidation of a CTE ``base(file, row_idx, <canonical columns>)``."""
    fills = ", ".join(
        f'{td.forward_fill_sql(chr(34) + k + chr(34), "file", "row_idx")} AS "{k}__f"' for k in spec.fill_keys if k in present
    )
    keys_sel = []
    for k in spec.keys:
        if k not in present:
            keys_sel.append(f"'' AS \"{k}\"")
        elif k in spec.fill_keys:
            keys_sel.append(f'"{k}__f" AS "{k}"')
        else:
            keys_sel.append(f"coalesce(\"{k}\", '') AS \"{k}\"")
    first_key = spec.keys[0]
    fk = f'"{first_key}__f"' if first_key in spec.fill_keys else f'"{first_key}"'
    if spec.marker_mode == "upper":
        cond = f"{fk} IS NOT NULL AND upper({fk}) NOT IN ({', '.join(repr(m) for m in spec.markers)})"
    else:
        cond = f"{fk} IS NOT NULL AND {fk} NOT IN ({', '.join(repr(m) for m in spec.markers)})"
    meas = []
    for c in present:
        if c in spec.keys:
            continue
        if c in spec.sums or (spec.parse_firsts and c in spec.firsts):
            meas.append(f'{td.accounting_parse_sql(chr(34) + c + chr(34))} AS "{c}"')
        elif c in spec.firsts:
            meas.append(f'"{c}"')
    kept = f"kept AS (SELECT file, row_idx, {', '.join(keys_sel)}, {', '.join(meas)} FROM filled WHERE {cond})"
    aggs = []
    for c in present:
        if c in spec.keys:
            continue
        if c in spec.firsts:
            e = f'arg_min_null("{c}", row_idx)'
            aggs.append((f"round({e}, 2)" if spec.parse_firsts else e) + f" AS {snake(c)}")
        elif c in spec.sums:
            aggs.append(f'round(sum("{c}"), 2) AS {snake(c)}')
    keys_out = ", ".join(f'"{k}" AS {snake(k)}' for k in spec.keys)
    group = ", ".join(f'"{k}"' for k in spec.keys)
    return (
        "WITH " + base_cte + f", filled AS (SELECT *, {fills} FROM base), " + kept
        + f" SELECT file, {keys_out}, {', '.join(aggs)} FROM kept GROUP BY file, {group}"
    )


def rows_sql(layout: Layout) -> str:
    """CTE ``rows(file, row_idx, values)``: the layout's workbooks in SQL."""
    t = "n_nationkey % 4"
    fname = file_name_sql(layout.file_prefix)
    title = (
        f"SELECT {fname} AS file, 0 AS row_idx, ['Report Summary', NULL] AS values FROM nation WHERE {t} > 0 "
        f"UNION ALL SELECT {fname}, 1, [NULL, 'Report period: 2025/' || CAST((n_nationkey + 3) % 12 + 1 AS VARCHAR)] FROM nation WHERE {t} > 1 "
        f"UNION ALL SELECT {fname}, 2, ['Prepared for ' || n_name, '  '] FROM nation WHERE {t} > 2"
    )
    header = f"SELECT {fname}, {t}, [{', '.join(c.header_sql for c in layout.columns)}] FROM nation"
    data = (
        f"SELECT {fname}, {t} + 1 + {_rec_sql(layout.source)}, "
        f"[{', '.join('CAST(' + c.value_sql + ' AS VARCHAR)' for c in layout.columns)}] FROM {_source_sql(layout.source)}"
    )
    return f"rows AS ({title} UNION ALL {header} UNION ALL {data})"


def output_columns(layout: Layout, spec: ReportSpec) -> list[str]:
    """Canonical columns the layout's files have, in the report's output order."""
    present = [c.canonical for c in layout.columns if c.canonical]
    order = list(spec.output_order) if spec.output_order else list(spec.keys) + list(spec.measures)
    return [c for c in order if c in present or c in spec.keys]
