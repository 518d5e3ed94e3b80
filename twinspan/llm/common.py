"""Shared plumbing: tables in the cluster's shared folder, Arrow batches in slices, ASCII helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own_dirs: dict[str, str] = {}
_made: list[str] = []  # paths of materialized tables, in order


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the session names it. Where it doesn't, a folder of our own if driver and executors are one
    process (tests), and else an error: a folder of each machine would lose rows."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="twinspan-")
    return _own_dirs[app]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage ends there, so a lost
    executor never repeats what came before. The table goes when the application ends. narrow: rows of some
    numbers, which many tasks make few of; they are gathered in a 16th of the shuffle partitions, as a file each
    would be thousands of tiny ones. Where few bytes make much work, the reader deals them out again (spread())."""
    spark = df.sparkSession
    if narrow:
        df = df.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    path = f"{shared_dir(spark)}/twinspan/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._twinspan_path = path
    _made.append(path)
    return out


def spread(df: DataFrame, n_rows: int, *keys: str, rows: int = 100_000) -> DataFrame:
    """The rows of a small table over as many tasks as its work is worth: one for each `rows`, and all of the shuffle's at least."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // rows)), *keys)


def discard(df: DataFrame) -> None:
    """Deletes a table made by materialize() which nothing reads any more."""
    _delete(df.sparkSession, [df._twinspan_path])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        fs, p = _path(spark, path)
        fs.delete(p, True)
        if path in _made:
            _made.remove(path)


def tables_made() -> set[str]:
    return set(_made)


def discard_all_but(spark: SparkSession, kept: set[str], *also: DataFrame) -> None:
    """Deletes the tables made since tables_made() gave `kept`, without those of `also`."""
    stay = kept | {df._twinspan_path for df in also}
    _delete(spark, [path for path in _made if path not in stay])


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about max_bytes, so that Python objects made from one stay few."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, int(batch.num_rows * max_bytes / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
