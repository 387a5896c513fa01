"""Workbook scan: many report files -> one rows table.

``spark.read.format("binaryFile")`` lists and reads the files (glob, path
filter and modification time are pushed to the listing); ``mapInPandas``
decodes each file in the task that holds it and emits one row per sheet row::

    file string, row_idx long, values array<string>

Every file goes through the same schema, so a directory of thousands of
workbooks is one DataFrame and one job; files are spread over tasks by the
scan.  A file that cannot be decoded to its end, or has no rows, yields one row
with ``row_idx = -1`` and the error text: a bad upload becomes a status row, not
a failed job and not half a table.  One file is held in memory at a time.

``.xlsx`` is a zip of XML parts and is read with the standard library (first
sheet only, shared strings, inline strings, numbers kept as their stored
text, cells in a date format as ISO text, error cells empty).  ``.csv`` is read with the ``csv`` module.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_SCHEMA = "file string, row_idx long, values array<string>, error string"

_NS = {
    "m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "pr": "http://schemas.openxmlformats.org/package/2006/relationships",
}
#: Error text of a file without any row; rows handed on at a time.
EMPTY_FILE = "The file has no rows."
CHUNK_ROWS = 20_000
_REF = re.compile(r"^([A-Z]+)([0-9]+)$")


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _text(el) -> str:
    return "".join(t.text or "" for t in el.iter(f"{{{_NS['m']}}}t"))


def _first_sheet_path(z: zipfile.ZipFile) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheet = wb.find("m:sheets/m:sheet", _NS)
    rid = sheet.get(f"{{{_NS['r']}}}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for rel in rels.findall("pr:Relationship", _NS):
        if rel.get("Id") == rid:
            target = rel.get("Target").lstrip("/")
            return target if target.startswith("xl/") else "xl/" + target
    return "xl/worksheets/sheet1.xml"


# Built-in number formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_LITERALS = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]|_.')


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    dates = set(_DATE_FORMATS)
    for f in root.findall("m:numFmts/m:numFmt", _NS):
        if re.search("[ymdhs]", _LITERALS.sub("", f.get("formatCode", "")), re.I):
            dates.add(int(f.get("numFmtId")))
    return {i for i, xf in enumerate(root.findall("m:cellXfs/m:xf", _NS)) if int(xf.get("numFmtId") or 0) in dates}


def _date_text(serial: str, from_1904: bool) -> str:
    """A day number as ``2025-11-01`` (with its time when it has one)."""
    first = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
    at = first + timedelta(seconds=round(float(serial) * 86400))
    return at.strftime("%Y-%m-%d" if at.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")


def _cell(c, shared: list[str], dates: set[int], from_1904: bool) -> str | None:
    kind, v = c.get("t"), c.find("m:v", _NS)
    if kind == "inlineStr":
        held = c.find("m:is", _NS)
        return _text(held) if held is not None else None
    if v is None or v.text is None or kind == "e":  # error cells (#N/A) hold no value
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "true" if v.text == "1" else "false"
    if kind in (None, "n") and int(c.get("s") or 0) in dates:
        return _date_text(v.text, from_1904)
    return v.text


def xlsx_rows(content: bytes) -> Iterator[tuple[int, list]]:
    """(row_idx, values) of the first sheet; missing and error cells are None,
    date cells ISO text."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        sst = ET.fromstring(z.read("xl/sharedStrings.xml"))
        shared = [_text(si) for si in sst.findall("m:si", _NS)]
    dates = _date_styles(z)
    props = ET.fromstring(z.read("xl/workbook.xml")).find("m:workbookPr", _NS)
    from_1904 = props is not None and props.get("date1904") in ("1", "true")
    last = -1
    with z.open(_first_sheet_path(z)) as sheet:
        for _, row in ET.iterparse(sheet):
            if row.tag != f"{{{_NS['m']}}}row":
                continue
            cells: dict[int, str | None] = {}
            for pos, c in enumerate(row.findall("m:c", _NS)):
                m = _REF.match(c.get("r") or "")
                cells[_col_index(m.group(1)) if m else pos] = _cell(c, shared, dates, from_1904)
            last = int(row.get("r")) - 1 if row.get("r") else last + 1
            row.clear()
            if cells:
                yield last, [cells.get(i) for i in range(max(cells) + 1)]


def csv_rows(content: bytes) -> Iterator[tuple[int, list]]:
    csv.field_size_limit(1 << 31)  # a cell may be as long as the file
    text = content.decode("utf-8-sig", errors="replace")
    for i, rec in enumerate(csv.reader(io.StringIO(text, newline=""))):
        yield i, [v if v != "" else None for v in rec]


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of each file, or one status row for a file that can't be read whole
    or has no rows; a file is decoded to its end before any row of it counts."""
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                rows = list((csv_rows if path.lower().endswith(".csv") else xlsx_rows)(bytes(content)))
                error = None if rows else EMPTY_FILE
            except Exception as e:  # noqa: BLE001 - a bad file becomes a status row
                rows, error = [], f"{type(e).__name__}: {e}"
            if error:
                rows = [(-1, [])]
            for a in range(0, len(rows), CHUNK_ROWS):
                part = rows[a:a + CHUNK_ROWS]
                yield pd.DataFrame({"file": path, "row_idx": [r for r, _ in part], "values": [v for _, v in part], "error": error})


def read_report_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Scan report files under ``path`` into the rows table (see module doc)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", "content")
    return files.mapInPandas(_decode, ROWS_SCHEMA)


def rows_to_cells(rows: DataFrame, max_row: int | None = None) -> DataFrame:
    """Rows table -> long cells ``(file, row_idx, col_idx, value)``; only rows
    below ``max_row`` when given (header discovery never needs more)."""
    r = rows.filter(F.col("row_idx") >= 0)
    if max_row is not None:
        r = r.filter(F.col("row_idx") < max_row)
    return r.select("file", "row_idx", F.posexplode("values").alias("col_idx", "value")).select(
        "file", "row_idx", F.col("col_idx").cast("int"), "value"
    )
