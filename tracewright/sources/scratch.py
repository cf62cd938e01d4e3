"""Folders for tables that a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of this process, kept until it ends (that deletes it).
_OWN: list[tempfile.TemporaryDirectory] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of spark.checkpoint.dir; unset, below a temporary one if all run in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is unset, and on {master} a folder of this machine would not be shared")
        if not _OWN:
            _OWN.append(tempfile.TemporaryDirectory(prefix="tracewright-", ignore_cleanup_errors=True))
        shared = "file://" + _OWN[0].name
    return f"{shared.rstrip('/')}/tracewright-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: what it was made from isn't computed again, and partition numbers stay as they are."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
