"""File admission and per-file ingest status.

A batch of uploads becomes rows ``(path, batch)``; admission is a column
predicate on the path and a per-batch aggregate, so one bad file rejects its
batch but never stops other batches, and a failing file becomes a status row
instead of an exception that would end the job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted upload extensions (case-insensitive).
ALLOWED_EXTENSIONS = ("xlsx", "xls", "csv")
NOT_READ = "The file was not read."
BATCH_REJECTED = "Batch rejected: unsupported file type or too many files."


def extension_ok(path_col: str, extensions: Sequence[str] = ALLOWED_EXTENSIONS):
    return F.lower(F.col(path_col)).rlike(r"\.(" + "|".join(extensions) + r")$")


def admit_files(files: DataFrame, path_col: str = "path", batch_col: str = "batch",
                max_files: int | None = None, extensions: Sequence[str] = ALLOWED_EXTENSIONS) -> DataFrame:
    """Add ``admitted`` (extension accepted) and ``batch_ok`` (every file of the
    batch admitted and, when ``max_files`` is set, at most that many files)."""
    f = files.withColumn("admitted", extension_ok(path_col, extensions))
    ok = F.bool_and("admitted")
    if max_files is not None:
        ok = ok & (F.count(F.lit(1)) <= max_files)
    per_batch = f.groupBy(batch_col).agg(ok.alias("batch_ok"))
    return f.join(per_batch, batch_col)


def ingest_status(admission: DataFrame, validation: DataFrame) -> DataFrame:
    """``(file, status, error)``, one row for every admitted or rejected file:
    rejected batches, files that were never read, failed validations, ok files."""
    j = admission.join(validation.select("file", "ok", F.col("error").alias("error")), "file", "left")
    return j.select(
        "file",
        F.when(~F.col("batch_ok"), F.lit("rejected")).when(F.col("ok"), F.lit("ok")).otherwise(F.lit("error")).alias("status"),
        F.when(~F.col("batch_ok"), F.lit(BATCH_REJECTED)).when(F.col("ok").isNull(), F.lit(NOT_READ)).otherwise(F.col("error")).alias("error"),
    )
