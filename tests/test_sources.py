"""Workbook scan on generated .xlsx bytes, table discovery, and a full ingest of
several files at once (the reference's generated-workbook tests, FIXTURES.md §2)."""

import os
import tempfile
import zipfile
from xml.sax.saxutils import escape

from ledgerfold.plans.reports import ingest
from ledgerfold.sources.tables import table_start, title_cells
from ledgerfold.sources.workbook import read_report_files
from ledgerfold.spec import CAPTIVE_SPEC, CAPTIVE_TARGETS


def _col_letter(i):
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def write_xlsx(path, rows):
    """Minimal workbook: inline strings and numbers, first sheet only."""
    sheet = ['<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>']
    for r, vals in enumerate(rows, start=1):
        sheet.append(f'<row r="{r}">')
        for c, v in enumerate(vals):
            ref = f"{_col_letter(c)}{r}"
            if v is None:
                continue
            if isinstance(v, (int, float)):
                sheet.append(f'<c r="{ref}"><v>{v}</v></c>')
            else:
                sheet.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
        sheet.append("</row>")
    sheet.append("</sheetData></worksheet>")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        z.writestr("xl/workbook.xml", '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
                   'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
                   '<sheet name="S1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", "".join(sheet))


HEADER = ["Captive Name: Captive Name", "Captive Name: Client"] + list(CAPTIVE_TARGETS[:10])


def _data_row(cap, cli, gwp):
    row = [cap, cli] + [None] * 10
    row[2 + HEADER[2:].index("Gross Written Premium")] = gwp
    return row


def test_scan_and_ingest(spark):
    d = tempfile.mkdtemp(prefix="ledgerfold-xlsx-")
    write_xlsx(os.path.join(d, "Test_November 2025.xlsx"), [
        ["Captive Summary"], [None, "Report period: 2025/09"], HEADER,
        _data_row("Cap A", "C1", "$100.00"), _data_row(None, "C2", 200), _data_row("Cap B", "C1", "(50)"),
        _data_row("Subtotal", None, 999)])
    write_xlsx(os.path.join(d, "plain.xlsx"), [HEADER, _data_row("Cap A", "C1", 1)])
    write_xlsx(os.path.join(d, "wrong.xlsx"), [["Other Col"], [1], [2]])
    with open(os.path.join(d, "broken.xlsx"), "wb") as f:
        f.write(b"not a zip")
    rows = read_report_files(spark, d, glob="*.xlsx")
    write_xlsx(os.path.join(d, "empty.xlsx"), [])
    errors = {r.file.rsplit("/", 1)[-1]: r.error for r in rows.filter("row_idx < 0").collect()}
    assert set(errors) == {"broken.xlsx", "empty.xlsx"} or set(errors) == {"broken.xlsx"}
    rows = read_report_files(spark, d, glob="*.xlsx")
    good = rows.filter("row_idx >= 0")

    starts = {r.file.rsplit("/", 1)[-1]: r.start for r in table_start(good, CAPTIVE_SPEC).collect()}
    assert starts == {"Test_November 2025.xlsx": 2, "plain.xlsx": 0, "wrong.xlsx": 0}
    title = [(r.row_idx, r.col_idx, r.value) for r in title_cells(good, table_start(good, CAPTIVE_SPEC))
             .orderBy("row_idx", "col_idx").collect()]
    assert title == [(0, 0, "Captive Summary"), (1, 1, "Report period: 2025/09")]

    res = ingest(rows, CAPTIVE_SPEC, block_rows=2)
    status = {r.file.rsplit("/", 1)[-1]: r.status for r in res.status.collect()}
    assert status == {"Test_November 2025.xlsx": "ok", "plain.xlsx": "ok", "wrong.xlsx": "error", "broken.xlsx": "error", "empty.xlsx": "error"}
    errors = {r.file.rsplit("/", 1)[-1]: r.error for r in res.status.collect()}
    assert errors["empty.xlsx"] == "The file has no rows." and "BadZipFile" in errors["broken.xlsx"]
    data = {(r.file.rsplit("/", 1)[-1], r["Captive Name: Captive Name"], r["Captive Name: Client"]): r["Gross Written Premium"]
            for r in res.data.collect()}
    assert data == {("Test_November 2025.xlsx", "Cap A", "C1"): 100.0, ("Test_November 2025.xlsx", "Cap A", "C2"): 200.0,
                    ("Test_November 2025.xlsx", "Cap B", "C1"): -50.0, ("plain.xlsx", "Cap A", "C1"): 1.0}
    meta = {r.file.rsplit("/", 1)[-1]: r for r in res.metadata.collect()}
    m = meta["Test_November 2025.xlsx"]
    assert m.period_from_filename == "November 2025" and m.period_from_header == "September 2025"
    assert m.canonical_period is None and m.discrepancy_notes == []
    assert m.filenames == ["Test_November 2025.xlsx"]
    assert res.staged
    res.close()
    assert not res.staged


def test_csv_scan(spark):
    d = tempfile.mkdtemp(prefix="ledgerfold-csv-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("x,y\n1,\n,2\n")
    got = [(r.row_idx, r["values"]) for r in read_report_files(spark, d).orderBy("row_idx").collect()]
    assert got == [(0, ["x", "y"]), (1, ["1", None]), (2, [None, "2"])]


def test_blank_header_as_client(spark):
    from ledgerfold.spec import CAPTIVE_CLIENT

    hdr = ["Captive Name: Captive Name", None] + list(CAPTIVE_TARGETS[:10])
    d = tempfile.mkdtemp(prefix="ledgerfold-blank-")
    row = ["Cap A", "C9"] + [None] * 10
    write_xlsx(os.path.join(d, "a.xlsx"), [hdr, row])
    rows = read_report_files(spark, d).filter("row_idx >= 0")
    plain = ingest(rows, CAPTIVE_SPEC).data.collect()
    assert [r[CAPTIVE_CLIENT] for r in plain] == [""]
    fixed = ingest(rows, CAPTIVE_SPEC.with_(blank_header_as=CAPTIVE_CLIENT)).data.collect()
    assert [r[CAPTIVE_CLIENT] for r in fixed] == ["C9"]


def test_half_read_file_gives_no_rows(spark):
    d = tempfile.mkdtemp(prefix="ledgerfold-half-")
    long = "y" * 200_000  # longer than the csv module's usual field limit
    with open(os.path.join(d, "long.csv"), "w") as f:
        f.write("a,b\n" + f"1,{long}\n" + "2,x\n")
    whole = [r.row_idx for r in read_report_files(spark, d).orderBy("row_idx").collect()]
    assert whole == [0, 1, 2]
    write_xlsx(os.path.join(d, "cut.xlsx"), [["a"], ["b"]])
    with zipfile.ZipFile(os.path.join(d, "bad.xlsx"), "w") as z, zipfile.ZipFile(os.path.join(d, "cut.xlsx")) as src:
        for n in src.namelist():
            body = src.read(n)
            z.writestr(n, body[:-40] if n.endswith("sheet1.xml") else body)
    got = [(r.row_idx, bool(r.error)) for r in read_report_files(spark, d, glob="bad.xlsx").collect()]
    assert got == [(-1, True)]


def test_dates_and_error_cells(spark):
    d = tempfile.mkdtemp(prefix="ledgerfold-date-")
    path = os.path.join(d, "a.xlsx")
    write_xlsx(path, [["x"]])
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = (f'<worksheet xmlns="{ns}"><sheetData><row r="1"><c r="A1" s="1"><v>45962</v></c><c r="B1" s="2"><v>45962.5</v></c>'
             '<c r="C1" t="e"><v>#N/A</v></c><c r="D1" s="0"><v>45962</v></c></row></sheetData></worksheet>')
    styles = (f'<styleSheet xmlns="{ns}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm&quot;h&quot;"/></numFmts>'
              '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>')
    with zipfile.ZipFile(os.path.join(d, "b.xlsx"), "w") as z, zipfile.ZipFile(path) as src:
        for n in src.namelist():
            z.writestr(n, sheet if n.endswith("sheet1.xml") else src.read(n))
        z.writestr("xl/styles.xml", styles)
    got = read_report_files(spark, d, glob="b.xlsx").first()
    assert got["values"] == ["2025-11-01", "2025-11-01 12:00:00", None, "45962"]


def test_low_table_and_search_limit(spark):
    body = [(f"note {i}",) for i in range(250)]
    rows = [("low", i, [v]) for i, (v,) in enumerate(body)] + [("low", 250, HEADER), ("low", 251, [str(x) if x is not None else None for x in _data_row("Cap A", "C1", 5)])]
    df = spark.createDataFrame(rows, "file string, row_idx long, values array<string>")
    assert [(r.start, r.found) for r in table_start(df, CAPTIVE_SPEC).collect()] == [(250, True)]
    ok = ingest(df, CAPTIVE_SPEC)
    assert [r.status for r in ok.status.collect()] == ["ok"] and ok.data.count() == 1
    limited = ingest(df, CAPTIVE_SPEC.with_(scan_rows=200)).status.first()
    assert (limited.status, limited.error) == ("error", "No table starts in the first 200 rows.")


def test_frontier_search_equals_the_whole_search(spark):
    """Tables at every edge of the windows, below other tables' windows, and none at all."""
    from ledgerfold.sources import tables

    edges = [0, 1, 255, 256, 257, 2047, 2048, 2049, 3000]
    rows = []
    for s in edges:
        rows += [(f"f{s}", i, [f"note {i}", None]) for i in range(0, s, 97)]
        rows += [(f"f{s}", s, HEADER), (f"f{s}", s + 40, HEADER), (f"f{s}", s + 5000, ["1"])]
    rows += [("none", i, ["x"]) for i in range(0, 20_000, 501)] + [("short", 0, ["Captive Nam"]), ("short", 1, None)]
    df = spark.createDataFrame(rows, "file string, row_idx long, values array<string>")
    staged = []
    got = {r.file: (r.start, r.found) for r in table_start(df, CAPTIVE_SPEC, staged=staged).collect()}
    whole = {r.file: r.start for r in tables._first_match(tables.rows_to_cells(df), CAPTIVE_SPEC).collect()}
    assert {f: s for f, (s, found) in got.items() if found} == whole == {f"f{s}": s for s in edges} | {f: 0 for f in whole if f == "short"}
    assert not got["none"][1] and len(staged) == 1
    limited = {r.file: r.found for r in table_start(df, CAPTIVE_SPEC.with_(scan_rows=257)).collect()}
    assert {f for f, found in limited.items() if found} == {f for f, s in whole.items() if s < 257}
    assert table_start(df.limit(0), CAPTIVE_SPEC).count() == 0


def test_later_windows_read_open_files_only(spark, monkeypatch):
    from ledgerfold.sources import tables

    rows = [("top", 0, HEADER)] + [("top", i, ["1"]) for i in range(1, 6000, 7)] + [("low", 4000, HEADER)]
    df = spark.createDataFrame(rows, "file string, row_idx long, values array<string>")
    seen = []
    plain = tables._first_match

    def watch(cells, spec):
        seen.append({(r.file, r.row_idx) for r in cells.select("file", "row_idx").distinct().collect()})
        return plain(cells, spec)

    monkeypatch.setattr(tables, "_first_match", watch)
    assert {r.file: r.start for r in table_start(df, CAPTIVE_SPEC).collect()} == {"top": 0, "low": 4000}
    assert {f for part in seen[1:] for f, _ in part} == {"low"} and max(i for _, i in seen[0]) < 256
