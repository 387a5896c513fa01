"""JSON bodies of open schema."""

from ledgerfold.sources.records import NOT_AN_OBJECT, NOT_LISTS, open_schema, read_records, typed


def test_kinds_of_bodies(spark):
    bodies = {
        "both": '{"data": [{"a": 1, "b c": "x"}, {"a": "2"}], "columns": ["a", "b c"]}', "missing": "{}", "null": '{"data": null, "columns": null}',
        "empty kinds": '{"data": "", "columns": {}}', "zero": '{"data": 0, "columns": false}', "zero point": '{"data": 0.0}',
        "object": '{"data": {"a": 1}, "columns": []}', "text": '{"data": [], "columns": "a"}', "digit text": '{"data": "0"}', "number": '{"data": 3}', "true": '{"columns": true}',
        "list": '[{"data": []}]', "no json": '{"data": [', "none": None, "empty text": "", "odd": '{"data": [1, null, [2], {"a": null}], "columns": [1, "x", null]}',
    }
    read = read_records(spark.createDataFrame(list(bodies.items()), "body_id string, body string"))
    got = {r.body_id: (r.status, r.error, r.total_rows, r.n_columns) for r in read.status.collect()}
    ok = {k: v[2:] for k, v in got.items() if v[:2] == ("ok", None)}
    assert ok == {"both": (2, 2), "missing": (0, 0), "null": (0, 0), "empty kinds": (0, 0), "zero": (0, 0), "zero point": (0, 0), "none": (0, 0), "odd": (4, 3)}
    assert {k for k, v in got.items() if v[1] == NOT_LISTS} == {"object", "text", "digit text", "number", "true"}
    assert {k for k, v in got.items() if v[1] == NOT_AN_OBJECT} == {"list", "no json", "empty text"}
    rows = typed(read.rows, {"a": "int", "b c": "string"})
    assert sorted((r.body_id, r.row_idx, r.a, r["b c"]) for r in rows.collect()) == [
        ("both", 0, 1, "x"), ("both", 1, 2, None), *(("odd", i, None, None) for i in range(4))]
    assert sorted((r.col_idx, r.name) for r in read.columns.filter("body_id = 'both'").collect()) == [(0, "a"), (1, "b c")]
    assert [r.name for r in read.columns.filter("body_id = 'odd'").orderBy("col_idx").collect()] == ["1", "x", "null"]


def test_open_schema_and_empty_table(spark):
    df = spark.createDataFrame([("s", '{"data": [{"a": 1}, {"a": 2.5, "b": "x"}]}')], "body_id string, body string")
    schema = open_schema(read_records(df).rows).first().schema
    assert schema.startswith("OBJECT<") and "b: STRING" in schema and "a: " in schema
    assert read_records(df.limit(0)).status.count() == 0
