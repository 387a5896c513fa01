"""Stored chart tables, found again by the content of a file's rows.

A file's key is a digest of an order-free fingerprint of its consolidated rows (their
number and the sums of two 64-bit row hashes), of its columns and of the charts'
definition.  The same rows in another order, or under another file name, are a hit; one
changed cell is a miss.  Keys are worked out for all files in one aggregate, only
the rows of missing keys are charted, and content that several files share is charted once.

Entries lie in one Parquet table under ``path`` (a shared folder), in 256 shards by
the first digits of the key.  All rows of a key are written by one task into
one file, so a key is there whole or not at all, also when a job is lost half way;
every key has a marker row, so files without any chart count as hits.
:meth:`ChartCache.keep_only` drops the entries that no file refers to any more, by
rewriting the shards that hold some.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators import file_charts
from ledgerfold.operators.file_charts import Chart
from ledgerfold.operators.summaries import resolve_column
from ledgerfold.plans.charts import FEE_RAP, FEE_RLIP, RENT, UNITS
from ledgerfold.session import materialize, release
from ledgerfold.spec import CAPTIVE_CLIENT, CAPTIVE_KEY

#: The charts of a captive report.
CAPTIVE_CHARTS = (
    Chart("top_rent", RENT, 7), Chart("top_units", UNITS, 5, take_first=True),
    Chart("fee_rlip", FEE_RLIP, 4, others=True), Chart("fee_rap", FEE_RAP, 4, others=True),
)
_ENTRY = f"shard string, key string, {file_charts.SCHEMA}"


def fingerprints(data: DataFrame, by: str = "file", version: str = "") -> DataFrame:
    """(by, key): a digest of each file's rows, whatever their order."""
    columns = sorted(c for c in data.columns if c != by)
    cells = [F.col(c) for c in columns] + [F.col(c).isNull() for c in columns]
    sums = [F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    said = hashlib.sha256(repr((version, columns, [dict(data.dtypes)[c] for c in columns])).encode()).hexdigest()
    return data.groupBy(by).agg(F.sha2(F.concat_ws("|", F.lit(said), F.count(F.lit(1)).cast("string"), *sums), 256).alias("key"))


class ChartCache:
    """Chart tables of consolidated reports under ``path``."""

    def __init__(self, spark: SparkSession, path: str, charts: Sequence[Chart] = CAPTIVE_CHARTS, share: tuple[str, str] | None = (FEE_RLIP, FEE_RAP)):
        self.spark, self.path, self.charts, self.share = spark, path, tuple(charts), share
        self.version = repr((self.charts, share))

    def entries(self) -> DataFrame:
        """All stored rows (shard, key, chart, ...); the marker rows have chart ''."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).parquet(self.path).filter("key <> ''")

    def _stored_keys(self) -> DataFrame:
        return self.entries().filter("chart = ''").select("key")

    def _write(self, rows: DataFrame, mode: str) -> None:
        one_file = rows.repartition("shard").sortWithinPartitions("shard", "key")
        one_file.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(self.path)

    def tables(self, data: DataFrame, order: Column, by: str = "file") -> tuple[DataFrame, DataFrame]:
        """(states, charts): (by, key, state hit or miss), and (by, chart, rank, label,
        value, percent), from the store; what it lacks is charted and stored first.
        The charts are read when they are used: write them before :meth:`keep_only`."""
        names = {c.measure: resolve_column(data.columns, c.measure) for c in self.charts}
        charts = [Chart(c.name, names[c.measure], c.top, c.take_first, c.others) for c in self.charts if names[c.measure]]
        share = tuple(resolve_column(data.columns, m) for m in self.share) if self.share else None
        share = share if share and all(share) else None

        keys = materialize(fingerprints(data, by, self.version))
        known = self._stored_keys().withColumn("hit", F.lit(True))
        states = materialize(keys.join(known, "key", "left").select(by, "key", F.when(F.col("hit"), "hit").otherwise("miss").alias("state")))
        missing = states.filter("state = 'miss'").groupBy("key").agg(F.min(by).alias(by))
        if not missing.isEmpty():
            rows = data.join(missing, by)
            made = file_charts.chart_tables(rows, charts, CAPTIVE_KEY, CAPTIVE_CLIENT, order, "key", share) if charts else None
            marks = missing.select("key", F.lit("").alias("chart"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("label"),
                                   F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("percent"))
            rows = made.unionByName(marks) if made is not None else marks
            self._write(rows.withColumn("shard", F.substring("key", 1, 2)), "append")
        found = self.entries().filter("chart <> ''").drop("shard")
        return states, states.select(by, "key").join(found, "key").drop("key")

    def keep_only(self, live: DataFrame) -> DataFrame:
        """Drop the entries of all keys but those in ``live`` (key); returns the dropped keys."""
        stale = materialize(self._stored_keys().join(live.select("key"), "key", "left_anti"))
        if stale.isEmpty():
            return stale
        shards = stale.select(F.substring("key", 1, 2).alias("shard")).distinct()
        kept = self.entries().join(shards, "shard", "left_semi").join(stale, "key", "left_anti").select("shard", "key", "chart", "rank", "label", "value", "percent")
        # A shard whose entries all go keeps an empty marker: Spark replaces only shards that get rows.
        blank = shards.select("shard", F.lit("").alias("key"), F.lit("").alias("chart"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("label"),
                              F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("percent"))
        staged: list[str] = []
        self._write(materialize(kept.unionByName(blank), staged), "overwrite")
        release(self.spark, staged)
        return stale
