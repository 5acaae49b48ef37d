"""The registered training jobs fit the whole models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardweave.operators import train
from cardweave.plans import queries


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c, at in (("a", 0), ("b", 1)):
        for i in range(400):
            x = rng.random(38).astype(np.float32)
            # The label turns with x in one category and against it in the other: one model for both can't tell.
            rows.append((len(rows), i, c, int((x[0] > 0.5) ^ bool(at)), x.tolist(), i % 5 == 0))
    return spark.createDataFrame(rows, "id1 bigint, id2 bigint, category string, target int, x array<float>, is_valid boolean").cache()


@pytest.fixture
def small(labelled, monkeypatch):
    monkeypatch.setattr(queries, "training", lambda spark, d: (labelled.filter("not is_valid"), labelled.filter("is_valid")))
    monkeypatch.setattr(queries, "vector", lambda: F.col("x"))
    return labelled


def test_boosting_query_has_all_iterations(spark, small, monkeypatch):
    fitted, real = [], train.train_boosting
    monkeypatch.setattr(train, "train_boosting", lambda *a, **k: fitted.append(real(*a, **k)) or fitted[-1])
    assert all(r.ap > 0.95 for r in queries.QUERIES["train_boosting"](spark, "").collect())
    counts = {r.category: r.n for r in fitted[0][0].groupBy("category").agg(F.countDistinct("tree").alias("n")).collect()}
    assert counts == {"a": 250, "b": 250, "__all__": 250}


def test_trees_query_has_300_trees_a_category(spark, small, monkeypatch):
    fitted, real = [], train.train_trees
    monkeypatch.setattr(train, "train_trees", lambda *a, **k: fitted.append(real(*a, **k)) or fitted[-1])
    assert all(r.ap > 0.95 for r in queries.QUERIES["train_extra_trees_like"](spark, "").collect())
    assert {r.category: r["count"] for r in fitted[0].groupBy("category").count().collect()} == {"a": 300, "b": 300}


def test_extra_tree_keeps_least_rows_and_has_no_depth_limit():
    rng = np.random.default_rng(2)
    x, y = rng.random((3000, 1)).astype(np.float32), rng.integers(0, 2, 3000).astype(float)
    feature, threshold, left, right, value = train.extra_tree(x, y, rng, 1, 20)

    def leaves(node, rows, depth):
        if left[node] < 0:
            assert len(rows) >= 20 and value[node] == pytest.approx(y[rows].mean())
            return [depth]
        goes = x[rows, feature[node]] <= np.float32(threshold[node])
        return leaves(left[node], rows[goes], depth + 1) + leaves(right[node], rows[~goes], depth + 1)

    assert max(leaves(0, np.arange(3000), 0)) > 10


def test_hybrid_query_boosts_with_each_human_weight(spark, small, monkeypatch):
    asked, real = [], train.train_boosting

    def kept(rows, *a, **k):
        asked.append((max(r.weight for r in rows.select("weight").distinct().collect()), k))
        return real(rows, *a, **k)

    monkeypatch.setattr(train, "train_boosting", kept)
    got = queries.QUERIES["train_weighted_hybrid"](spark, "").collect()
    assert [w for w, _ in asked] == [2, 5, 10] and all(k["weight"] == "weight" and "iterations" not in k for _, k in asked)
    assert {(r.human_weight, r.cat) for r in got} == {(w, c) for w in (2, 5, 10) for c in "ab"} and all(r.ap > 0.9 for r in got)
