"""Ranks, exact samples and train/validation splits; all settled by hashes, never by the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import name_signature


def draw(seed: int, *columns: str) -> Column:
    """A pseudorandom number of a row that other engines can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *columns)), 1, 8), 16, 10).cast("bigint")


def rank_pct(value: str, by: str) -> Column:
    """Percentile rank with ties at their average."""
    whole, ties = W.partitionBy(by), W.partitionBy(by, value)
    return (F.rank().over(W.partitionBy(by).orderBy(value)) + (F.count("*").over(ties) - 1) / 2) / F.count("*").over(whole)


def rank_blend(first: str, second: str, weight: float, by: str) -> Column:
    """Percentile ranks of two scores, weighed."""
    return weight * rank_pct(first, by) + (1 - weight) * rank_pct(second, by)


def sample_pairs(pairs: DataFrame, n: int, seed: int = 1234) -> DataFrame:
    """Exactly n pairs, or all."""
    return pairs.orderBy(draw(seed, "id1", "id2"), "id1", "id2").limit(n)


def at_most(rows: DataFrame, by: list[str], n: int, seed: int) -> DataFrame:
    """Up to n rows of each group."""
    nth = F.row_number().over(W.partitionBy(*by).orderBy(draw(seed, "id1", "id2"), "id1", "id2"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= n).drop("nth")


def stratified(rows: DataFrame, by: str, n: int, seed: int = 1234) -> DataFrame:
    """About n rows, each group in proportion; rows without a group go."""
    rows = rows.filter(F.col(by).isNotNull())
    counts = rows.groupBy(by).agg(F.count("*").alias("size"))
    total = counts.agg(F.sum("size").alias("total")).first()[0] or 0
    quota = counts.select(by, F.bround(F.col("size") * min(1.0, n / max(1, total)), 0).alias("quota"))
    nth = F.row_number().over(W.partitionBy(by).orderBy(draw(seed, "id1", "id2"), "id1", "id2"))
    return rows.join(quota, by).withColumn("nth", nth).filter("nth <= quota").drop("nth", "quota")


def _last(rows: DataFrame, order: list[Column], share: float) -> DataFrame:
    group = W.partitionBy("category", "target")
    nth, size = F.row_number().over(group.orderBy(*order)), F.count("*").over(group)
    return rows.withColumn("is_valid", nth <= F.greatest(F.lit(1), F.bround(size * share, 0)))


def random_split(rows: DataFrame, share: float = 0.2, seed: int = 2026) -> DataFrame:
    """is_valid for an exact share of each category and target."""
    return _last(rows, [draw(seed, "id1", "id2"), F.col("id1"), F.col("id2")], share)


def tail_split(rows: DataFrame, share: float = 0.2) -> DataFrame:
    """is_valid for the last rows, by id1, of each category and target; at least one."""
    return _last(rows, [F.desc("id1"), F.desc("id2")], share)


def group_split(rows: DataFrame, share: float = 0.2, seed: int = 2026) -> DataFrame:
    """is_valid by the hash of category and first name, so that equal names stay together."""
    folds = max(2, round(1 / share))
    signature = F.concat_ws("|", "category", name_signature(F.col("name1")))
    at = F.conv(F.substring(F.md5(signature), 1, 8), 16, 10).cast("bigint") % folds
    return rows.withColumn("is_valid", at == seed % folds)
