"""Cards and pairs from the driver's tables (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    size = F.col("p_size").cast("string")
    some = lambda when, *x: F.when(when, F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])).otherwise("")
    attributes = F.concat(
        F.lit('{"Тип": "'), "p_type", F.lit('"'),
        some(key % 5 != 0, ', "Бренд": "', F.replace("p_brand", F.lit("#"), F.lit("")), '"'),
        some(key % 3 != 0, ', "Размер": ', size),
        some(key % 4 != 0, ', "Артикул": "A', (key % 13).cast("string"), '"'),
        F.lit("}"),
    )
    return part.select(
        key.cast("bigint").alias("id"), F.concat("p_name", some(key % 4 == 1, " ", size)).alias("name"),
        attributes.alias("attributes"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), key.cast("bigint").alias("row_idx"),
    )


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cards, named by their whole text."""
    docs, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    attributes = F.when(key % 3 != 0, F.concat(F.lit('{"источник": "'), "source", F.lit('"}')))
    return docs.select(key.alias("id"), F.col("text").alias("name"), attributes.alias("attributes"), F.col("lang").alias("category"), key.alias("row_idx"))


def near_pairs(items: DataFrame, reach: int, label: str | None = "brand", same: tuple[str, ...] = ("category",)) -> DataFrame:
    """Pairs of cards with equal same columns and 0 < id2 - id1 <= reach, by buckets of ids: each card meets the cards
    of its own bucket and of the one before only."""
    cell = F.floor(F.col("id") / reach)
    extra = [label] if label else []
    left = items.select(F.col("id").alias("id1"), cell.alias("cell"), *same, *[F.col(c).alias("l1") for c in extra])
    right = items.select(F.col("id").alias("id2"), F.explode(F.array(cell, cell - 1)).alias("cell"), *same, *[F.col(c).alias("l2") for c in extra])
    gap = F.col("id2") - F.col("id1")
    target = (F.col("l1") == F.col("l2")).cast("int") if label else F.lit(0)
    return left.join(right, ["cell", *same]).filter((gap > 0) & (gap <= reach)).select("id1", "id2", target.alias("target"))


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_row(near_pairs(part_items(spark, sf_dir), 40))


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_row(near_pairs(document_items(spark, sf_dir), 5, label=None))


def with_row(pairs: DataFrame) -> DataFrame:
    """row_idx from the ids, which the fixtures keep below 2 ** 31."""
    return pairs.withColumn("row_idx", F.col("id1") * F.lit(1 << 31) + F.col("id2"))
