"""Average precision by category and its macro mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ap_per_category(scored: DataFrame, *more: str) -> DataFrame:
    """(cat, ap) of scored (y, s, cat), or for each value of more columns too: the step sum over distinct scores, ties as
    one step. Null categories and those of a single class are left out. Rows are counted by score before any window,
    which then sees distinct scores."""
    by = [*more, "cat"]
    steps = scored.filter("cat is not null").groupBy(*by, "s").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    down, whole = W.partitionBy(*by).orderBy(F.desc("s")), W.partitionBy(*by)
    steps = steps.select(*by, "p", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("nn"), F.sum("p").over(whole).alias("pa"), F.sum("n").over(whole).alias("na"))
    return steps.filter("pa > 0 and pa < na").groupBy(*by).agg(F.sum(F.col("p") / F.col("pa") * F.col("tp") / F.col("nn")).alias("ap"))


def ap_of_scorers(scored: DataFrame, scorers: dict[str, Column]) -> DataFrame:
    """(scorer, cat, ap) of several scores of the same rows (y, cat, …), in one pass over them."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scorer"), x.cast("double").alias("s")) for n, x in scorers.items()]))
    return ap_per_category(scored.select("y", "cat", each.alias("each")).select("y", "cat", "each.*"), "scorer")


def macro_ap(scored: DataFrame) -> DataFrame:
    return ap_per_category(scored).agg(F.coalesce(F.avg("ap"), F.lit(float("nan"))).alias("macro_ap"))


def ap_range(scored: DataFrame) -> DataFrame:
    return ap_per_category(scored).agg(F.min("ap").alias("lowest"), F.max("ap").alias("highest"))


def single_class(scored: DataFrame) -> DataFrame:
    return scored.groupBy("cat").agg(F.sum("y").alias("p"), F.count("*").alias("n")).filter("p = 0 or p = n").select("cat")


def extrapolated(seconds: float, rows: int, total: int, limit: float) -> tuple[float, bool]:
    """Seconds that total rows would take, and whether that keeps the limit."""
    far = seconds * total / max(1, rows)
    return far, far <= limit
