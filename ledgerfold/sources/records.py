"""Records source: JSON bodies ``{"data": [...], "columns": [...]}`` of any schema.

Bodies are parsed once into VARIANT values, so records keep whatever fields and types they
have; typed columns are taken out of them by name, by Spark's own functions.  Each
body gets one status row.  ``data`` and ``columns`` count as empty lists when they are
missing, null, or empty or zero of any kind; other values that are no lists make the
body an error, as does a text that is no JSON object.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.sqltext import lit, q

# Error texts.
NOT_LISTS = "Request body must have 'data' (array) and 'columns' (array)."
NOT_AN_OBJECT = "Request body must be a JSON object."

#: Kinds of a value that count as an empty list, by their JSON text.
_EMPTY = ("null", "false", "0", '""', "{}", "[]")


@dataclass
class Records:
    status: DataFrame  # (id, status, error, total_rows, n_columns)
    rows: DataFrame  # (id, row_idx, record VARIANT)
    columns: DataFrame  # (id, col_idx, name)


def _is_list(v: str) -> str:
    return f"schema_of_variant({v}) LIKE 'ARRAY<%'"


def _field(name: str) -> str:
    """The field as a variant; null when it is missing or counts as empty."""
    value = f"try_variant_get(body, '$.{name}', 'variant')"
    zero = f"coalesce(try_variant_get({value}, '$', 'double') = 0, false) AND schema_of_variant({value}) NOT LIKE '%STRING%'"
    return f"CASE WHEN {value} IS NULL OR is_variant_null({value}) OR to_json({value}) IN ({', '.join(map(lit, _EMPTY))}) OR {zero} THEN NULL ELSE {value} END AS {name}"


def read_records(bodies: DataFrame, id_col: str = "body_id", body_col: str = "body") -> Records:
    """Bodies (id, JSON text) -> status, rows and columns.  A null body counts as ``{}``."""
    text = F.coalesce(F.col(body_col), F.lit("{}"))
    parsed = bodies.select(F.col(id_col), F.try_parse_json(text).alias("body"))
    parsed = parsed.withColumn("object", F.expr("coalesce(schema_of_variant(body) LIKE 'OBJECT<%', false)"))
    parsed = parsed.withColumn("body", F.when(F.col("object"), F.col("body")))
    parts = parsed.selectExpr(q(id_col), "object", _field("data"), _field("columns"))
    fit = parts.withColumn("ok", F.expr(f"object AND (data IS NULL OR {_is_list('data')}) AND (columns IS NULL OR {_is_list('columns')})"))
    lists = fit.selectExpr(
        q(id_col), "object", "ok",
        "CASE WHEN ok THEN coalesce(try_variant_get(data, '$', 'array<variant>'), array()) END AS data",
        "CASE WHEN ok THEN coalesce(try_variant_get(columns, '$', 'array<variant>'), array()) END AS columns",
    )
    error = F.when(~F.col("object"), NOT_AN_OBJECT).when(~F.col("ok"), NOT_LISTS)
    status = lists.select(id_col, F.when(F.col("ok"), "ok").otherwise("error").alias("status"), error.alias("error"),
                          F.size("data").cast("long").alias("total_rows"), F.size("columns").cast("long").alias("n_columns"))
    status = status.withColumns({c: F.when(F.col("status") == "ok", F.col(c)) for c in ("total_rows", "n_columns")})
    rows = lists.select(id_col, F.posexplode("data").alias("row_idx", "record")).withColumn("row_idx", F.col("row_idx").cast("long"))
    columns = lists.select(id_col, F.posexplode("columns").alias("col_idx", "v")).select(
        id_col, "col_idx", F.expr("coalesce(try_variant_get(v, '$', 'string'), to_json(v))").alias("name")
    )
    return Records(status, rows, columns)


def typed(rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Records with columns of the given names and types; a field that is missing or
    does not fit its type is null, as is every field of a record that is no object."""
    kept = [c for c in rows.columns if c != "record"]
    held = rows.select(*kept, F.expr("try_variant_get(record, '$', 'map<string,variant>')").alias("__fields"))
    return held.selectExpr(*map(q, kept), *(f"try_variant_get(try_element_at(__fields, {lit(n)}), '$', '{kind}') AS {q(n)}" for n, kind in columns.items()))


def open_schema(rows: DataFrame, id_col: str = "body_id") -> DataFrame:
    """(id, schema): the common schema of each body's records, as Spark's text."""
    return rows.groupBy(id_col).agg(F.schema_of_variant_agg("record").alias("schema"))
