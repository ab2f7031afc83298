"""Cut a lineage with a table in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where unset, a temporary folder in local mode and an error on a cluster.

    A folder of one machine is no folder of the others: what an executor writes there, no other can read.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            where = jvm_dir.get()
        elif not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            where = "file://" + tempfile.mkdtemp(prefix="millrace-")
            spark.sparkContext.setCheckpointDir(where)
    return where


def durable(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a reader of it.

    A lost executor costs a re-read, not a recomputation, and non-deterministic
    columns (partition ids) are fixed for every later use.  The table is smaller
    than a serialized-row checkpoint and stays until the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if not _WRITTEN:
        atexit.register(_clean)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: the folder's owner cleans up
            return
