"""Staged acceptance: prepared inputs, a timed run, the output contract; the first failure ends it."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairs import used_items, validate_output
from ..operators.sampling import sample_pairs
from ..sources import tables
from .pipeline import predict_pipeline

#: Pairs and seconds of each stage.
STAGES = {"check": (1_000, 60), "public": (115_000, 360), "private": (275_000, 780)}


def prepare(items: DataFrame, pairs: DataFrame, n: int, folder: str, seed: int = 1234) -> None:
    """n pairs without labels, and the cards that they use."""
    blind = sample_pairs(pairs, n, seed).select("id1", "id2")
    blind.write.mode("overwrite").parquet(f"{folder}/pairs")
    used_items(items, blind).select("id", "name", "attributes", "category").write.mode("overwrite").parquet(f"{folder}/items")


def accept(spark: SparkSession, items: DataFrame, pairs: DataFrame, folder: str, stages: dict[str, tuple[int, int]] = STAGES, run: Callable = predict_pipeline, seed: int = 1234, **options) -> list[tuple[str, float, list[str]]]:
    """(stage, seconds, errors) of each stage that ran."""
    done = []
    for stage, (n, limit) in stages.items():
        at = f"{folder}/{stage}"
        prepare(items, pairs, n, at, seed)
        began = time.perf_counter()
        try:
            run(spark, f"{at}/items", f"{at}/pairs", f"{at}/out", **options)
        except Exception as failure:  # whatever ends the run is the stage's result
            done.append((stage, time.perf_counter() - began, [f"the run failed: {failure}"]))
            break
        took = time.perf_counter() - began
        found = validate_output(spark.read.parquet(f"{at}/pairs"), tables.read_submission(spark, f"{at}/out"))
        errors = [f"{r.check_name}: {r.n_bad}" for r in found.filter(F.col("n_bad") > 0).collect()]
        errors += [f"took {took:.0f} s of {limit}"] if took > limit else []
        done.append((stage, took, errors))
        if errors:
            break
    return done
