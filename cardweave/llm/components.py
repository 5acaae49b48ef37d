"""Connected components: on arrays within a task, and across the cluster by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, uncut


def local_components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the links u-v."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for at in (u, v, label[u], label[v]):
            np.minimum.at(new, at, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node reachable.

    Alternating large-star and small-star: each round is a grouped minimum, which combines map-side, and a join,
    whose skewed side Spark can split; nothing is gathered per node. Each round is cut in the shared folder.
    """

    def minima(edges: DataFrame) -> DataFrame:
        return edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(minima(both), "a").filter("b > a and b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = minima(large)
        moved = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        old, edges = edges, cut(moved.unionByName(low.withColumnRenamed("low", "b")).filter("a <> b").distinct(), "links")
        uncut(old)
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
