"""Joins of pairs with their cards, and set operations on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, json_text, strip


def last_items(items: DataFrame, keep: str = "last") -> DataFrame:
    """One row for each id: the last one by row_idx, or the first. A grouped maximum, so it combines map-side."""
    pick = F.max_by if keep == "last" else F.min_by
    rest = [c for c in items.columns if c != "id"]
    return items.groupBy("id").agg(pick(F.struct(*rest), F.col("row_idx")).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in rest])


def item_text(with_category: bool = False) -> Column:
    """Name and flat attributes, and the category if asked for."""
    parts = [blank(F.col("name")), F.lit(" "), json_text(F.col("attributes"))]
    return strip(F.concat(*parts, *([F.lit(" "), blank(F.col("category"))] if with_category else [])))


def baseline_text() -> Column:
    """'Name: … Category: … Attributes: k: v …'."""
    from ..functions.text import parse_json

    pairs = F.transform(F.map_entries(parse_json(F.col("attributes"))), lambda e: F.concat_ws(": ", e["key"], F.coalesce(e["value"], F.lit("None"))))
    return F.concat(F.lit("Name: "), blank(F.col("name")), F.lit(" Category: "), blank(F.col("category")), F.lit(" Attributes: "), F.coalesce(F.array_join(pairs, " "), F.lit("")))


def used_items(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Items of the pairs only."""
    return items.join(ids_of(pairs).withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left_semi")


def ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("id1").alias("id")).union(pairs.select("id2")).distinct()


def attach(pairs: DataFrame, items: DataFrame, columns: dict[str, Column], category: str = "coalesce") -> DataFrame:
    """pairs with each side's columns (name1, name2, …) and category; no pair is lost, unknown ids give nulls.

    columns are computed once an item, before the join. category: of id1, else of id2; "first": of id1 only.
    """
    view = last_items(items).select("id", F.col("category").alias("cat"), *[x.alias(n) for n, x in columns.items()])
    names = ["cat", *columns]
    sides = [view.select(F.col("id").alias(f"id{i}"), *[F.col(n).alias(f"{n}{i}") for n in names]) for i in (1, 2)]
    both = pairs.join(sides[0], "id1", "left").join(sides[1], "id2", "left")
    cat = F.coalesce("cat1", "cat2") if category == "coalesce" else F.col("cat1")
    return both.withColumn("category", cat).drop("cat1", "cat2")


def with_texts(pairs: DataFrame, items: DataFrame) -> DataFrame:
    out = attach(pairs, items, {"text": item_text()})
    return out.withColumns({c: blank(F.col(c)) for c in ("text1", "text2")})


def missing_text() -> Column:
    return (F.col("text1") == "") | (F.col("text2") == "")


def inner_pairs(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The baseline's pairs: those with an unknown id go."""
    return attach(pairs, items, {"text": baseline_text()}).filter(F.col("text1").isNotNull() & F.col("text2").isNotNull())


def both_sides_in(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    for side in ("id1", "id2"):
        pairs = pairs.join(ids.select(F.col("id").alias(side)), side, "left_semi")
    return pairs


def in_categories(pairs: DataFrame, items: DataFrame, names: str) -> DataFrame:
    """Pairs whose first card has one of the categories in a list with commas; space around a name doesn't count."""
    wanted = [n.strip() for n in names.split(",")]
    return pairs.join(last_items(items).filter(F.col("category").isin(wanted)).select(F.col("id").alias("id1")), "id1", "left_semi").select(*pairs.columns)


def missing_predictions(expected: DataFrame, produced: DataFrame) -> DataFrame:
    return expected.select("id1", "id2").distinct().join(produced.select("id1", "id2"), ["id1", "id2"], "left_anti")


def repeated_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("id1", "id2").agg(F.count("*").alias("n")).filter("n > 1")


def bad_number(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def validate_output(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """(check_name, n_bad) for each rule of the output contract; all 0 if it holds."""
    if produced.columns != ["id1", "id2", "predict"]:
        return expected.sparkSession.createDataFrame([("columns", 1)], "check_name string, n_bad bigint")
    n = lambda df, name: df.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("check_name"), "n_bad")
    rows = expected.agg(F.count("*").alias("a"), F.lit(1).alias("one")).join(produced.agg(F.count("*").alias("b"), F.lit(1).alias("one")), "one")
    rows = rows.select(F.lit("row_count").alias("check_name"), F.abs(F.col("a") - F.col("b")).alias("n_bad"))
    more = repeated_pairs(produced).join(repeated_pairs(expected).withColumnRenamed("n", "m"), ["id1", "id2"], "left").filter("n > coalesce(m, 1)")
    return (
        rows.unionByName(n(produced.filter(bad_number(F.col("predict").cast("double"))), "not_a_number"))
        .unionByName(n(missing_predictions(expected, produced), "missing_pairs"))
        .unionByName(n(more, "repeated_pairs"))
    )
