"""File-arrival ingestion with Structured Streaming.

Uploads land in a folder; a ``binaryFile`` stream picks up new files, and each
micro-batch runs the same batch ingestion (:func:`ledgerfold.plans.reports.ingest`)
over the files of that batch.  Output is published file by file
(:class:`ledgerfold.plans.publish.Publication`): a batch's data, metadata and status are
seen together, a file that comes again replaces its own rows, and a batch replayed after a
failure replaces itself.  The stream's progress lives in a checkpoint location under the
session's shared checkpoint folder unless one is given.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerfold.plans.reports import ingest
from ledgerfold.session import checkpoint_dir
from ledgerfold.sources.workbook import ROWS_SCHEMA, _decode
from ledgerfold.spec import ReportSpec


BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def start_ingest_stream(
    spark: SparkSession,
    source_dir: str,
    sink_dir: str,
    spec: ReportSpec,
    glob: str = "*.xlsx",
    checkpoint_location: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    files = reader.load(source_dir)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("path", "content").mapInPandas(_decode, ROWS_SCHEMA)
        res = ingest(rows, spec, stage_rows=True)
        res.write(sink_dir)
        res.close()

    key = hashlib.sha256(f"{source_dir}|{sink_dir}|{glob}".encode()).hexdigest()[:16]
    location = checkpoint_location or os.path.join(checkpoint_dir(spark), "streams", f"ingest-{spec.name}-{key}")
    writer = files.writeStream.foreachBatch(run_batch).option("checkpointLocation", location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
