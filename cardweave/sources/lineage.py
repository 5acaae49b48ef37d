"""Intermediate tables in the shared folder: plans stay small and a lost executor loses nothing.

They lie under spark.checkpoint.dir, in a folder of the application that goes with it; temporary() removes them earlier.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_marked: set[str] = set()
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, on one machine an own folder, on a cluster an error:
    executors don't share a local one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="cardweave-"))
    return _own[0]


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def scratch(spark: SparkSession) -> str:
    """The application's folder, which its file system deletes when the application ends."""
    path = f"{shared_dir(spark)}/cardweave/{spark.sparkContext.applicationId}"
    if path not in _marked:
        files, at = _files(spark, path)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _marked.add(path)
    return path


def cut(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.parquet(path, compression=codec)
    found = spark.read.schema(df.schema).parquet(path)
    found.cut_path = path
    return found


def uncut(table: DataFrame) -> None:
    """Removes a table that cut() returned and that nothing reads any more."""
    remove(table.sparkSession, table.cut_path)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables cut within are removed at the end: what is made of them must be written by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)
