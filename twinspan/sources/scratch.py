"""Folders that driver and executors share, and text written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the session names it; else a folder of our own if driver and executors are one process
    (tests), and an error on a cluster, as a folder of each machine would lose rows."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="twinspan-engine-")
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path there, deleted when the application ends."""
    path = f"{scratch_dir(spark)}/twinspan/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def as_text(lines: DataFrame, name: str) -> str:
    """Writes a table with one string column, a line a row, and returns its path."""
    path = scratch_path(lines.sparkSession, name)
    lines.write.text(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what comes before is computed once, and not again when an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
