"""Inference: expanded linear models and forests, routed by category with one fallback model."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FALLBACK = "__all__"
THRESHOLDS = (0.0, 0.10, 0.25, 0.50, 0.75, 0.90, 0.99)
#: Models are broadcast: one a category, each of bounded size. Beyond this many it is an error, not a plan.
MAX_MODELS = 10_000


def expand(x: Column) -> Column:
    """x, its squares, the roots of max(x, 0) and x > t for each threshold, one block after the other, in float.
    A feature that isn't a number is above no threshold."""
    above = lambda t: F.transform(x, lambda v: F.when(~F.isnan(v) & (v > F.lit(t).cast("float")), 1.0).otherwise(0.0).cast("float"))
    return F.concat(
        x,
        F.transform(x, lambda v: v * v),
        F.transform(x, lambda v: F.sqrt(F.greatest(v, F.lit(0.0).cast("float"))).cast("float")),
        *[above(t) for t in THRESHOLDS],
    )


def route(rows: DataFrame, models: DataFrame) -> DataFrame:
    """rows with the columns of their category's model, or of the fallback for an unknown or null one.

    The fallback's name is put into rows of unknown categories first, so one broadcast join serves all.
    """
    known = [r.category for r in models.select("category").distinct().limit(MAX_MODELS + 1).collect()]
    if len(known) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models")
    name = F.when(F.col("category").isin(known), F.col("category")).otherwise(FALLBACK)
    return rows.withColumn("model", name).join(F.broadcast(models.withColumnRenamed("category", "model")), "model", "left")


def linear_scores(rows: DataFrame, models: DataFrame, features: Column, name: str = "predict") -> DataFrame:
    """rows with the margin of their linear model (category, coef, intercept)."""
    width = 10 * 38
    found = route(rows.withColumn("__x", expand(features)), models)
    ok = F.size("coef") == F.size("__x")
    total = F.aggregate(F.zip_with("__x", "coef", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    checked = F.when(ok, total + F.col("intercept")).otherwise(F.raise_error(F.lit(f"a model's coefficients aren't as many as expanded features, such as {width}")).cast("double"))
    return found.withColumn(name, checked).drop("__x", "coef", "intercept", "model")


def probability(rows: DataFrame, model: DataFrame, features: Column, name: str = "predict") -> DataFrame:
    """rows with the probability of class 1 under a model of one row (coef, intercept)."""
    from ..functions.similarity import dot

    of = model.select("coef", "intercept").first()
    margin = dot(features.cast("array<double>"), F.lit(of.coef)) + of.intercept
    return rows.withColumn(name, 1 / (1 + F.exp(-margin)))


def forest_scores(rows: DataFrame, forest: DataFrame, baseline: DataFrame, features: Column, name: str = "predict") -> DataFrame:
    """rows with baseline and leaf values of their category's trees summed: at a node, left if x <= threshold, and
    where missing_left says so for what isn't a number. Rows walk a tree together, in Arrow batches."""
    if baseline.select("category").distinct().limit(MAX_MODELS + 1).count() > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models")
    start = {r.category: np.float32(r.baseline) for r in baseline.collect()}
    trees: dict[str, dict[int, dict]] = defaultdict(dict)
    for (category, tree), nodes in forest.orderBy("category", "tree", "node").toPandas().groupby(["category", "tree"], sort=True):
        at = nodes.set_index("node").reindex(range(int(nodes.node.max()) + 1))
        trees[category][int(tree)] = {c: at[c].fillna(0).to_numpy() for c in ("feature", "left", "right")} | {
            "threshold": at.threshold.to_numpy(np.float32), "value": at.value.fillna(0).to_numpy(np.float32),
            "missing_left": at.missing_left.fillna(False).to_numpy(bool), "is_leaf": at.is_leaf.fillna(True).to_numpy(bool),
        }

    @F.pandas_udf("double")
    def walk(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for category, x in batches:
            which = category.where(category.isin(list(start)), FALLBACK).to_numpy()
            table = np.stack(x.to_numpy()).astype(np.float32) if len(x) else np.zeros((0, 1), np.float32)
            out = np.full(len(x), np.nan)
            for c in set(which):
                rows = np.flatnonzero(which == c)
                if c not in start:
                    continue
                total = np.full(len(rows), start[c], np.float32)
                for t in trees[c].values():
                    node = np.zeros(len(rows), np.int64)
                    active = np.flatnonzero(~t["is_leaf"][node])
                    while len(active):
                        at = node[active]
                        v = table[rows[active], t["feature"][at].astype(np.int64)]
                        left = np.where(np.isnan(v), t["missing_left"][at], v <= t["threshold"][at])
                        node[active] = np.where(left, t["left"][at], t["right"][at]).astype(np.int64)
                        active = active[~t["is_leaf"][node[active]]]
                    total += t["value"][node]
                out[rows] = total
            yield pd.Series(out)

    return rows.withColumn(name, walk(F.coalesce("category", F.lit("None")), features))


def embedding_scores(pairs: DataFrame, vectors: DataFrame, name: str = "predict") -> DataFrame:
    """pairs (text1, text2 or id1, id2 as key1, key2) with the dot product of their vectors (key, vector); 0 without one."""
    from ..functions.similarity import dot

    sides = [vectors.select(F.col("key").alias(f"key{i}"), F.col("vector").alias(f"v{i}")) for i in (1, 2)]
    both = pairs.join(sides[0], "key1", "left").join(sides[1], "key2", "left")
    return both.withColumn(name, F.coalesce(dot(F.col("v1"), F.col("v2")), F.lit(0.0))).drop("v1", "v2")
