"""Session helpers: a local session for tests and a shared checkpoint folder.

On a cluster the session already exists and carries ``spark.checkpoint.dir``
(a shared, fault-tolerant folder); we only read it.  A folder of our own is set
only when the setting is missing, which happens in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerfold") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # HotSpot never JIT-compiles methods over 8000 bytes of bytecode; wide
        # report projections would otherwise run as interpreted whole-stage
        # code.  Spark's own docs suggest 8000 on HotSpot (3x faster parse here).
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEDGERFOLD_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session; set one only when unset (tests)."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if conf_dir:
        if current is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        # A machine-local folder would not survive the loss of an executor.
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (cluster runs need one)")
    # Only reached in local runs (tests) where no folder is named.
    local_dir = tempfile.mkdtemp(prefix="ledgerfold-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local_dir)
    sc.setCheckpointDir(local_dir)
    return local_dir


def materialize(df: DataFrame, staged: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` as a parquet table in the shared checkpoint
    folder and reading it back.

    Used for small intermediate tables that feed several branches (table
    starts, header rows, header mappings) and for the consolidated table that
    several summaries read (the chart cache of the reference).  The written
    table survives the loss of executors, unlike a local checkpoint or an
    in-memory cache, and it is computed once (an RDD checkpoint of an
    uncached plan computes it twice).  ``staged`` collects the folders, for
    :func:`release`; ``compression`` names another codec than the session's.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", uuid.uuid4().hex)
    df.write.mode("overwrite").parquet(path, compression=compression)
    if staged is not None:
        staged.append(path)
    return spark.read.parquet(path)


def release(spark: SparkSession, staged: list[str]) -> None:
    """Delete staged tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while staged:
        path = jvm.org.apache.hadoop.fs.Path(staged.pop())
        path.getFileSystem(conf).delete(path, True)
