"""Misra-Gries summaries of a column, made per partition and merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_SHARE, on_workers


def reduce_counters(counters: dict, size: int) -> dict:
    """Subtracts the (size + 1)th largest count from all and keeps what stays above 0: at most size counters."""
    if len(counters) <= size:
        return counters
    over = np.partition(np.fromiter(counters.values(), np.int64, len(counters)), -size - 1)[-size - 1]
    return {k: n - over for k, n in counters.items() if n > over}


def frequent(df: DataFrame, key: str, total: int, share: float = HEAVY_SHARE) -> DataFrame:
    """Distinct values of key that may hold at least that share of total rows: all that do, and 2 / share at most.

    With 2 / share counters a partition of n rows undercounts a value by n * share / 2 at most, so over all
    partitions a value with share * total rows keeps total * share / 2, and at most 2 / share values can.
    """
    on_workers(df.sparkSession)
    size = int(2 / share)
    kind = df.schema[key].dataType
    schema = f"key {kind.simpleString()}, est bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict = {}
        for batch in batches:
            seen = batch.column(0).value_counts()
            for k, n in zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist(), strict=True):
                counters[k] = counters.get(k, 0) + n
            counters = reduce_counters(counters, size)
        arrow = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}[kind.simpleString()]
        yield pa.RecordBatch.from_arrays([pa.array(counters, arrow), pa.array(counters.values(), pa.int64())], names=["key", "est"])

    found = df.select(key).filter(F.col(key).isNotNull()).mapInArrow(run, schema)
    return found.groupBy("key").agg(F.sum("est").alias("est")).filter(F.col("est") >= max(1, int(total * share / 2))).select(F.col("key").alias(key))
