"""Intermediate tables in the folder that driver and executors share.

A written table cuts the lineage: when an executor is lost, its tasks read the table again
instead of recomputing what led to it, and all readers see the same rows even where the
computation behind them isn't deterministic (task attempts, generated block numbers).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset and the session is local (tests) a
    folder of our own. Elsewhere a missing setting raises: executors don't share local folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tarnlake-")
    return _own[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and return the written table.

    The folder is deleted by release(), at the latest when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    df.write.option("compression", "zstd").parquet(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, for files that aren't tables; deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/f-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for name in df.inputFiles()[:1]:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent()
            if at.toString().rsplit("/", 1)[-1].startswith("t-"):
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
