"""What the operators share: the shared folder, lineage cuts, Arrow passes over texts, skew-proof joins."""

from __future__ import annotations

import contextlib
import ctypes
import os
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lineage import cut, shared_dir, uncut

__all__ = ["cut", "shared_dir", "uncut"]

#: White space of every contract of this subpackage: [\x20\x09-\x0D].
SPACE = "[ \\x09-\\x0D]"

#: A key with at least this share of all rows is handled map-side; there are at most 1 / HEAVY_SHARE such keys.
HEAVY_SHARE = 1 / 1000

#: Rows of 24 bytes that are broadcast at most: some 200 MB as a hash table.
BROADCAST_ROWS = 2_000_000

def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package where the folder is shared; elsewhere it goes out with --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def free_name(name: str, columns: Iterable[str]) -> str:
    """name, or name with underscores behind it, that none of columns is called in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells its rows apart and stays the same whenever docs is read, and that column's name.

    Rows of a scan have their file (its name's hash) and their place in it, so nothing is copied; other rows are
    written to the shared folder with a number.
    """
    name, node = free_name("row", docs.columns), docs._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.getClass().getSimpleName() == "LogicalRelation":
        with contextlib.suppress(AnalysisException):  # a scan of something other than files
            at = docs.metadataColumn("_metadata")
            return docs.withColumn(name, F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("at"))), name
    return cut(docs.withColumn(name, F.struct(F.lit(0).cast("bigint").alias("file"), F.monotonically_increasing_id().alias("at"))), "docs"), name


def without(docs: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """docs without the rows of dropped, which has docs' column row, and without that column. Up to BROADCAST_ROWS
    dropped rows are broadcast, so the texts aren't shuffled; more take a shuffle join."""
    dropped = cut(dropped.select(F.col(dropped.columns[0]).alias(row)), "dropped")
    few = dropped.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(dropped) if few else dropped.hint("merge"), row, "left_anti").drop(row)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def map_rows(df: DataFrame, work: Callable[[list[list]], list[list]], schema: str, rows: int = 512) -> DataFrame:
    """Runs work over df's columns, as lists, in pieces of so many rows; it returns the columns of schema as lists.

    Memory in a Python worker is bounded by one Arrow batch and the output of one piece.
    """
    on_workers(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                piece = batch.slice(start, rows)
                done = work([c.to_pylist() for c in piece.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, out, strict=True)], schema=out)
            give_back()

    return df.mapInArrow(run, schema)


@contextlib.contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches have so many rows at most in what is run within: JVM and Python worker each hold whole ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, usual)


def give_back() -> None:
    """Returns what a Python worker has freed to the system: workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def join_by_key(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """Joins rows to one row a key. Keys with HEAVY_SHARE of total rows, at most 1 / HEAVY_SHARE of them, are
    broadcast, so no task gets all rows of a hot key; the other keys are shuffled.

    per_key has the column count, each key's number of rows; it is left out of the result. key isn't null.
    """
    least = max(2, int(total * HEAVY_SHARE))
    heavy = per_key.filter(F.col(count) >= least).drop(count)
    light = per_key.filter(F.col(count) < least).drop(count)
    hot = F.broadcast(heavy)
    return rows.join(hot, key, "inner").unionByName(rows.join(hot.select(key), key, "left_anti").join(light, key, how))


def overlap(spans: Iterable[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a span shares a character with any of these; each question takes logarithmic time."""
    starts, stops = [], []
    for start, stop in sorted(spans):
        if stops and start <= stops[-1]:
            stops[-1] = max(stops[-1], stop)
        else:
            starts.append(start)
            stops.append(stop)

    def shared(start: int, stop: int) -> bool:
        before = bisect_left(starts, stop)
        return before > 0 and stops[before - 1] > start

    return shared


def spans_sha256(spans: Column, kinds: tuple[str, ...]) -> Column:
    """sha256 of the kind:start:end of the spans of these kinds, in order."""
    return F.sha2(spans_text(F.filter(spans, lambda s: s["kind"].isin(*kinds))), 256)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
