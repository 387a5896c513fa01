"""Atomic publication of a report set's tables, replaced file by file.

Each publication writes its tables into folders of its own (a generation) and then
one manifest, which names the generation of every file.  The manifest is renamed into
place as the last step and never overwritten; readers take the newest one and read
all tables through it.  So a reader sees every table of a publication or none, a
failure half way leaves the old state, and a file that comes again replaces its own rows
only: nothing of the other files is read or written.  Of two publications at the same
time the later one finds the manifest's number taken and adds itself to the newer state.

The folder must be on a file system whose rename of a directory is atomic and
refuses an existing target (HDFS, local).
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "file string, gen string"


class Publication:
    """Tables by file under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """Number of the newest manifest; 0 before the first publication."""
        fs, at = self._fs(f"{self.path}/manifests")
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(file, gen) of the newest, or a given, version."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests/{version:012d}")

    def _install(self, made: str, version: int) -> bool:
        """Rename a written manifest into place; false if the number is taken."""
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs(self.path)[1].toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(jvm.org.apache.hadoop.fs.Path(made), jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{version:012d}"), plain)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def publish(self, tables: Mapping[str, DataFrame], files: DataFrame) -> int:
        """Replace the files listed in ``files`` (file) by their rows in ``tables`` (each with a
        column ``file``); returns the version from which on they are seen."""
        gen = f"g{uuid.uuid4().hex}"  # never read as a number
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/tables/{name}/gen={gen}")
        new = files.select("file").distinct().withColumn("gen", F.lit(gen))
        while True:
            now = self.version()
            made = f"{self.path}/manifests/_{gen}_{now}"
            old = self.manifest(now).join(new.select("file"), "file", "left_anti")
            old.unionByName(new).write.mode("overwrite").parquet(made)
            if self._install(made, now + 1):
                return now + 1

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of the newest, or a given, version.  Take one version to read several
        tables that belong together."""
        live = self.manifest(version)
        rows = self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.path}/tables/{name}").parquet(f"{self.path}/tables/{name}")
        return rows.join(live, ["file", "gen"]).drop("gen")
