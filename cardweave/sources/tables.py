"""Scans and sinks of cards, pairs, features, models and results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINEAR = T.StructType([T.StructField("category", T.StringType()), T.StructField("coef", T.ArrayType(T.FloatType())), T.StructField("intercept", T.FloatType())])
FOREST = "category string, tree int, node int, feature int, threshold float, missing_left boolean, left int, right int, is_leaf boolean, value float"
OUTPUT = "id1 bigint, id2 bigint, predict double"


def load_items(spark: SparkSession, path: str) -> DataFrame:
    """id, name, attributes, category of an items file, with row_idx in file order."""
    return numbered(spark.read.parquet(path)).select(F.col("id").cast("bigint").alias("id"), "name", "attributes", "category", "row_idx")


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    """id1, id2, target (null where the file has none), row_idx."""
    rows = numbered(spark.read.parquet(path))
    target = F.col("target").cast("double") if "target" in rows.columns else F.lit(None).cast("double")
    return rows.select(F.col("id1").cast("bigint").alias("id1"), F.col("id2").cast("bigint").alias("id2"), target.alias("target"), "row_idx")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds row_idx: rows by file name, then by position in the file. The number is sparse but keeps that order.

    Files are numbered in a table of their own, which a join brings to the rows; Catalyst picks it by size."""
    at = rows.metadataColumn("_metadata")
    files = rows.select(at["file_path"].alias("__file")).distinct().withColumn("__number", F.row_number().over(W.orderBy("__file")) - 1)
    found = rows.withColumns({"__path": at["file_path"], "__at": at["row_index"]}).join(files, F.col("__path") == F.col("__file"))
    return found.withColumn("row_idx", F.col("__number").cast("bigint") * F.lit(1 << 40) + F.col("__at")).drop("__path", "__at", "__number", "__file")


def blocks(pairs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """block and pairs' columns, where both ids lie in one block of so many rows of items. Of the items only ids are read."""
    at = items.select("id", F.floor(F.col("row_idx") / size).alias("block"))
    left = pairs.join(at.withColumnsRenamed({"id": "id1"}), "id1")
    return left.join(at.withColumnsRenamed({"id": "id2"}), ["id2", "block"]).select("block", *pairs.columns)


def write_submission(scored: DataFrame, path: str) -> None:
    """One CSV file with a header, in the order of the pairs."""
    scored.select("row_idx", "id1", "id2", "predict").repartition(1).sortWithinPartitions("row_idx").drop("row_idx").write.mode("overwrite").csv(path, header=True)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=OUTPUT)


def write_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str, columns: list[str], rows: int) -> DataFrame | None:
    """A feature cache, or None if there is none; ValueError if it has other columns or another number of rows."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if not set(columns) <= set(found.columns) or found.count() != rows:
        raise ValueError(f"{path} has the features of other pairs")
    return found


def write_model(model: DataFrame, path: str, names: list[str]) -> None:
    """A model table with the names of the features that it was trained on."""
    model.withColumn("feature_names", F.array(*map(F.lit, names))).write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A model table; ValueError if it was trained on other features."""
    model = spark.read.parquet(path)
    if "feature_names" not in model.columns or model.select("feature_names").distinct().collect() != [T.Row(feature_names=names)]:
        raise ValueError("the model was trained on other features")
    return model.drop("feature_names")
