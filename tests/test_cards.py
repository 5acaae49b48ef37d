"""Edge cases and properties of the card-matching engine."""

import math

import pytest
from pyspark.sql import functions as F

from cardweave.functions import text as tx
from cardweave.operators import features as ft
from cardweave.operators import metrics, models, pairs, sampling, tfidf
from cardweave.plans.pipeline import predict_pipeline, predict_scores, scorer
from cardweave.sources import tables

SCHEMA = "id bigint, name string, attributes string, category string, row_idx bigint"


def cards(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)


def paired(spark, rows):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "id1 bigint, id2 bigint, row_idx bigint")


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("given", "expected"), [("{bad", {}), ('{"a": null}', {}), ("[1,2]", {}), (None, {}), ('{"a":1}xx', {}), ('{"Цвет":"a","цвет!":"b"}', {"цвет": "b"}), ('{"Ё": "Ёлка"}', {"е": "елка"})])
def test_json_attributes(spark, given, expected):
    rows = spark.createDataFrame([(given,)], "x string").select(tx.json_entries(F.col("x")).alias("e"))
    assert rows.select(tx.attributes(F.col("e")).alias("y")).first().y == expected


@pytest.mark.parametrize(("given", "expected"), [("{bad", "{bad"), ('{"a": null}', "a None"), (None, ""), ('{"a":"b","c":1}', "a b c 1")])
def test_json_text(spark, given, expected):
    assert one(spark, given, tx.json_text) == expected


def test_short_name_is_its_own_gram(spark):
    assert one(spark, "ab", tx.grams) == ["ab"]
    assert one(spark, "", tx.grams) == []
    assert one(spark, "ab cd", tx.grams) == ["abc", "bcd"]


def test_unknown_cards_have_no_features_but_equal_presence(spark):
    row = ft.structured(ft.joined(paired(spark, [(8, 9)]), cards(spark, [(1, "a", None, "x")]))).first()
    assert {n for n in ft.NAMES[:36] if row[n] != 0} == {"digit_presence_equal", "article_presence_equal", "brand_presence_equal"}


def test_last_card_wins_and_features_are_symmetric(spark):
    items = cards(spark, [(1, "old", None, "x"), (1, "Ёлка 12 зелёная", '{"Марка":"Y"}', "x"), (2, "елка 12", '{"Марка":"Y z"}', "x")])
    a, b = ft.structured(ft.joined(paired(spark, [(1, 2), (2, 1)]), items)).orderBy("row_idx").collect()
    assert [a[n] for n in ft.NAMES[:36]] == [b[n] for n in ft.NAMES[:36]]
    assert a.name_jaccard == pytest.approx(2 / 3) and a.brand_jaccard == 0.5


def test_tfidf_by_hand(spark):
    rows = spark.createDataFrame([(0, "aa bb", "aa cc"), (1, "", "aa")], "row_idx bigint, text1 string, text2 string")
    got = {r.row_idx: r.s for r in tfidf.tfidf(rows, "s").collect()}
    # Only aa is in two texts or more.
    assert got == {0: pytest.approx(1.0), 1: 0.0}


def test_char_terms(spark):
    assert sorted(one(spark, "a bc", tx.char_terms)) == sorted([" a", "a ", " a ", " b", "bc", "c ", " bc", "bc ", " bc "])


def test_boundaries_of_expansion(spark):
    got = one(spark, [0.1, float("nan")], models.expand, "array<float>")
    assert got[6:10] == [1.0, 0.0, 0.0, 0.0]


def test_average_precision_with_ties_and_single_class(spark):
    rows = spark.createDataFrame([(1, 0.5, "a"), (0, 0.5, "a"), (0, 0.1, "a"), (0, 1.0, "b")], "y int, s double, cat string")
    assert [(r.cat, r.ap) for r in metrics.ap_per_category(rows).collect()] == [("a", 0.5)]
    assert math.isnan(metrics.macro_ap(rows.filter("cat = 'b'")).first().macro_ap)


def test_average_rank(spark):
    rows = spark.createDataFrame([(x, "c") for x in (1, 1, 2, 5)], "s int, cat string")
    assert sorted(r.p for r in rows.select(sampling.rank_pct("s", "cat").alias("p")).collect()) == [0.375, 0.375, 0.75, 1.0]


def test_output_contract_counts_input_multiplicity(spark):
    expected = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "id1 bigint, id2 bigint")
    good = expected.withColumn("predict", F.lit(1.0))
    assert all(r.n_bad == 0 for r in pairs.validate_output(expected, good).collect())
    bad = {r.check_name: r.n_bad for r in pairs.validate_output(expected, good.filter("id1 = 1").withColumn("predict", F.lit(float("inf")))).collect()}
    assert bad == {"row_count": 1, "not_a_number": 2, "missing_pairs": 1, "repeated_pairs": 0}


def test_unknown_scorer():
    with pytest.raises(ValueError, match="tfidf"):
        scorer("other")


def test_files_in_and_out_keep_every_pair_in_order(spark, tmp_path):
    cards(spark, [(1, "red lamp", None, "x"), (2, "red lamp big", '{"k":"v"}', "x")]).drop("row_idx").coalesce(1).write.parquet(f"{tmp_path}/i")
    spark.createDataFrame([(2, 1), (1, 9), (1, 2), (2, 1)], "id1 bigint, id2 bigint").coalesce(1).write.parquet(f"{tmp_path}/p")
    assert predict_pipeline(spark, f"{tmp_path}/i", f"{tmp_path}/p", f"{tmp_path}/o") == 4
    got = [(r.id1, r.id2) for r in tables.read_submission(spark, f"{tmp_path}/o").collect()]
    assert got == [(2, 1), (1, 9), (1, 2), (2, 1)]


def test_missing_text_scores_zero(spark):
    model = spark.createDataFrame([("__all__", [1.0] * 380, 5.0)], "category string, coef array<float>, intercept float")
    got = predict_scores(paired(spark, [(1, 9), (1, 1)]), cards(spark, [(1, "a b", None, "x")]), "supervised", model).orderBy("row_idx").collect()
    assert got[0].predict == 0 and got[1].predict > 5


def test_model_guard(spark, tmp_path):
    model = spark.createDataFrame([("__all__", [1.0], 0.0)], "category string, coef array<float>, intercept float")
    tables.write_model(model, f"{tmp_path}/m", ["a", "b"])
    assert tables.read_model(spark, f"{tmp_path}/m", ["a", "b"]).count() == 1
    with pytest.raises(ValueError, match="other features"):
        tables.read_model(spark, f"{tmp_path}/m", ["a"])
