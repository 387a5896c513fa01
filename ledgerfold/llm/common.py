"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, folder: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, read it back, and let go of
    the shuffles behind it.  ``folder`` collects the paths, for ``release``.

    Spark drops a finished shuffle's files once the driver's collector has found
    it unused; jobs of many steps would otherwise hold all of them until the end.
    """
    out = materialize(df, folder, compression)
    spark = df.sparkSession
    del df
    gc.collect()
    spark._jvm.System.gc()
    return out


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 1024) -> DataFrame:
    """Apply ``fn`` to slices of at most ``rows`` rows of every Arrow batch, so
    that what ``fn`` makes on the way stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def crc_mod(doc_id: Column | str, m: int) -> Column:
    """crc32 of the id's decimal text, modulo ``m`` (null id: null)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % m


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (wrapping arithmetic)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def texts_of(col: pa.Array) -> list[str]:
    """Python strings of a text column; null counts as empty."""
    return [t or "" for t in col.to_pylist()]



def map_sorted_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to the rows of every key (integers, never null).

    Rows are dealt out and sorted by the keys; a task then reads its rows batch
    by batch and holds one group at a time.  Callers bound the groups' size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.array([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                now = tuple(key[:, a].tolist())
                if held and now != last:
                    yield fn(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = now
        if held:
            yield fn(pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column of equal length as a double matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(col), dim)


def usable(vector: Column | str) -> Column:
    """Whether a vector takes part: not null, without null or non-finite
    components, and not all zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & good & F.exists(v, lambda x: x != 0), F.lit(False))
