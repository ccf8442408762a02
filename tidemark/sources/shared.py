"""The folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for tables that outlive a stage.

    ``spark.checkpoint.dir`` names it, else the folder given to ``setCheckpointDir``. In a
    local session without either it lies beside the warehouse; on a cluster that would be
    one machine's disk, so there the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    set_later = context._jsc.sc().getCheckpointDir()
    if set_later.isDefined():
        return set_later.get().rstrip("/")
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files at or under a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
