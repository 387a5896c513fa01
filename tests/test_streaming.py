"""File-arrival stream: two workbooks in a folder, one available-now run."""

import os
import tempfile

from test_sources import HEADER, _data_row, write_xlsx

from ledgerfold.plans.publish import Publication
from ledgerfold.spec import CAPTIVE_SPEC
from ledgerfold.streaming.arrivals import start_ingest_stream


def test_stream_ingest(spark):
    src = tempfile.mkdtemp(prefix="ledgerfold-in-")
    sink = tempfile.mkdtemp(prefix="ledgerfold-out-")
    write_xlsx(os.path.join(src, "a.xlsx"), [HEADER, _data_row("Cap A", "C1", 5), _data_row(None, "C1", 6)])
    write_xlsx(os.path.join(src, "b.xlsx"), [["Title"], HEADER, _data_row("Cap B", None, "$1.50")])
    q = start_ingest_stream(spark, src, sink, CAPTIVE_SPEC, checkpoint_location=os.path.join(sink, "_ckpt"))
    q.awaitTermination(300)
    out = Publication(spark, sink)
    data = out.read("data")
    got = {(r["Captive Name: Captive Name"], r["Gross Written Premium"]) for r in data.collect()}
    assert got == {("Cap A", 11.0), ("Cap B", 1.5)}
    assert {r.status for r in out.read("status").collect()} == {"ok"} and out.read("metadata").count() == 2
    write_xlsx(os.path.join(src, "c.xlsx"), [HEADER, _data_row("Cap C", "C1", 2)])
    start_ingest_stream(spark, src, sink, CAPTIVE_SPEC, checkpoint_location=os.path.join(sink, "_ckpt")).awaitTermination(300)
    assert {(r["Captive Name: Captive Name"], r["Gross Written Premium"]) for r in out.read("data").collect()} == got | {("Cap C", 2.0)}
