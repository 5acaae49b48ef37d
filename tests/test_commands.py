"""Training, evaluation and acceptance end to end, and the parts that they are made of against plain versions."""

import json
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cardweave.__main__ import main
from cardweave.operators import metrics, models, pairs, sampling, train
from cardweave.operators.encoder import by_length, encode, encode_pairs
from cardweave.operators.features import NAMES
from cardweave.plans import harness, pipeline, training
from cardweave.sources import tables


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Cards of two categories; a pair matches if both cards tell of the same thing."""
    at, rng = tmp_path_factory.mktemp("cards"), np.random.default_rng(3)
    things = [f"{a} {b}" for a in ("red", "blue", "wide", "tall", "soft") for b in ("lamp", "chair", "table", "shelf")]
    items = []
    for i in range(160):
        thing = i // 2 % len(things)
        attributes = json.dumps({"model": f"m{thing}", "size": int(rng.integers(9))})
        items.append((i, f"{things[thing]} {rng.integers(3)}", attributes if i % 13 else "{bad", ("home", "office")[i // 2 % 2]))
    pd.DataFrame(items, columns=["id", "name", "attributes", "category"]).to_parquet(at / "items.parquet")
    found = []
    for i in range(0, 160, 2):
        found += [(i, i + 1, 1), *[(i, int(j) * 2 + 1, 0) for j in rng.integers(0, 79, 4) if j * 2 != i and (j - i // 2) % len(things)]]
    labelled = pd.DataFrame(found, columns=["id1", "id2", "target"]).drop_duplicates(["id1", "id2"])
    labelled.to_parquet(at / "pairs.parquet")
    labelled.assign(target=np.where(labelled.target == 1, 8 / 9, np.where(labelled.id2 % 3 == 0, 2 / 9, 0.0))).to_parquet(at / "soft.parquet")
    return at


@pytest.fixture
def given(files):
    return ["--items", str(files / "items.parquet"), "--matches", str(files / "pairs.parquet")]


def plain_ap(y, s):
    order, total, hits, ap, k = np.argsort(-s, kind="stable"), y.sum(), 0, 0.0, 0
    while k < len(order):
        tie = [i for i in order[k:] if s[i] == s[order[k]]]
        k += len(tie)
        hits += y[tie].sum()
        ap += y[tie].sum() / total * hits / k
    return ap


def submission(spark, at, pairs_path):
    out = tables.read_submission(spark, str(at)).toPandas()
    asked = pd.read_parquet(pairs_path)
    assert out[["id1", "id2"]].to_numpy().tolist() == asked[["id1", "id2"]].to_numpy().tolist()
    return out.predict.to_numpy(), asked.target.to_numpy()


def test_train_linear_reports_and_writes_a_model_that_scores(spark, files, given, tmp_path, capsys):
    model, cache = str(tmp_path / "model"), str(tmp_path / "cache")
    assert main(["train-linear", *given, "--output", model, "--feature-cache", cache, "--split", "random"], spark) == 0
    said = capsys.readouterr().out
    assert all(n in said for n in ("text_tfidf", "global", "supervised 0.25 text_tfidf", "home", "office"))
    assert {r.category for r in tables.read_model(spark, model, NAMES).collect()} == {"home", "office", "__all__"}
    pipeline.predict_pipeline(spark, given[1], given[3], str(tmp_path / "out"), "supervised", model)
    scores, target = submission(spark, tmp_path / "out", given[3])
    shuffled = np.random.default_rng(0).random(len(target))
    assert plain_ap(target, scores) > plain_ap(target, shuffled) + 0.3
    with pytest.raises(ValueError, match="other pairs"):
        training.labelled_features(tables.load_pairs(spark, given[3]).limit(3), tables.load_items(spark, given[1]), cache)
    assert main(["train-linear", *given, "--feature-cache", cache, "--skip-refit", "--split", "name-group"], spark) == 0
    with pytest.raises(SystemExit):
        main(["train-linear", *given], spark)


def test_train_boosted_writes_a_model_that_scores_and_is_accepted(spark, files, given, tmp_path, monkeypatch, capsys):
    model = str(tmp_path / "model")
    assert main(["train-boosted", *given, "--output", model, "--max-iter", "20", "--min-leaf", "5"], spark) == 0
    pipeline.predict_pipeline(spark, given[1], given[3], str(tmp_path / "out"), "boosted", model)
    scores, target = submission(spark, tmp_path / "out", given[3])
    assert plain_ap(target, scores) > plain_ap(target, np.random.default_rng(0).random(len(target))) + 0.3
    monkeypatch.setattr(harness, "STAGES", {"check": (40, 600), "public": (80, 600)})
    monkeypatch.delenv("MATCH_METHOD", raising=False)
    stages = ["accept", *given, "--folder", str(tmp_path / "stages"), "--model_path", model, "--stage"]
    assert main([*stages, "all"], spark) == 0
    assert capsys.readouterr().out.count("passed") == 2
    assert spark.read.parquet(str(tmp_path / "stages/check/pairs")).columns == ["id1", "id2"]


@pytest.mark.parametrize("fault", ["crash", "time", "rows", "number", "columns"])
def test_acceptance_ends_at_the_first_failure(spark, files, given, tmp_path, fault):
    items, labelled = tables.load_items(spark, given[1]), tables.load_pairs(spark, given[3])

    def run(spark, items_path, pairs_path, out):
        if fault == "crash":
            raise RuntimeError("no")
        found = spark.read.parquet(pairs_path).withColumn("predict", F.lit(float("nan") if fault == "number" else 0.5))
        if fault == "rows":
            found = found.limit(20)
        if fault == "columns":
            found = found.withColumn("predict", F.lit("x"))
        found.write.csv(out, header=True)

    done = harness.accept(spark, items, labelled, str(tmp_path), {"a": (30, 0 if fault == "time" else 600), "b": (40, 600)}, run)
    assert [s for s, _, _ in done] == ["a"] and done[0][2]


def test_evaluate_equals_a_plain_average_precision(spark, files, given, capsys):
    items, labelled = tables.load_items(spark, given[1]), tables.load_pairs(spark, given[3])
    report, took, n = training.evaluate(items, labelled, "tfidf", categories=" home , nowhere")
    of = {r.id: r.category for r in items.collect()}
    asked = [r for r in labelled.collect() if of[r.id1] == "home"]
    assert n == len(asked) and took > 0
    scores = {(r.id1, r.id2): r.predict for r in pipeline.predict_scores(pairs.in_categories(labelled, items, "home"), items).collect()}
    want = plain_ap(np.array([r.target for r in asked]), np.array([scores[r.id1, r.id2] for r in asked]))
    assert [(r.cat, pytest.approx(r.ap)) for r in report.collect()] == [("home", want)]
    assert main(["evaluate", *given, "--method", "tfidf", "--sample", "60"], spark) == 0
    said = capsys.readouterr().out
    assert "macro" in said and "private: 275000 pairs" in said


def test_evaluate_lists_the_lowest_first(spark, files, given):
    report = training.evaluate(tables.load_items(spark, given[1]), tables.load_pairs(spark, given[3]))[0].collect()
    assert len(report) == 2 and [r.ap for r in report] == sorted(r.ap for r in report)


def test_compare_and_hybrid(spark, files, given, capsys):
    assert main(["compare", *given, "--max-iter", "10", "--min-leaf", "5"], spark) == 0
    assert main(["hybrid", *given, "--soft-items", given[1], "--soft-matches", str(files / "soft.parquet"), "--block-rows", "80"], spark) == 0
    said = capsys.readouterr().out
    assert all(n in said for n in ("home", "macro", "soft confident", "hybrid 2", "hybrid 5", "hybrid 10"))


def test_soft_sample_keeps_to_blocks_and_their_bound(spark, files, given):
    items, soft = tables.load_items(spark, given[1]), tables.load_pairs(spark, str(files / "soft.parquet"))
    of = {r.id: (r.id // 40, r.category) for r in items.collect()}
    got = training.soft_sample(soft, items, 40, 5)
    assert got.columns == soft.columns
    inside, counts = defaultdict(int), defaultdict(int)
    for r in soft.collect():
        if of[r.id1][0] == of[r.id2][0]:
            inside[of[r.id1]] += 1
    for r in got.collect():
        assert of[r.id1][0] == of[r.id2][0]
        counts[of[r.id1]] += 1
    assert counts == {k: min(5, n) for k, n in inside.items()}


def test_holdout_report_equals_plain_ranks_and_blends(spark):
    rng = np.random.default_rng(8)
    rows = pd.DataFrame({"y": rng.integers(0, 2, 60), "cat": ["a", "b"] * 30} | {n: rng.integers(0, 12, 60) / 8 for n in ("text_tfidf", "global", "supervised")})
    got = {(r.scorer, r.cat): r.ap for r in training.holdout_report(spark.createDataFrame(rows)).collect()}
    rank = {n: rows.groupby("cat")[n].rank(pct=True) for n in ("text_tfidf", "global", "supervised")}
    scores = {n: rows[n] for n in rank}
    for other in ("global", "text_tfidf"):
        scores |= {f"supervised {w:.2f} {other}": w * rank["supervised"] + (1 - w) * rank[other] for w in (0.25, 0.5, 0.75)}
    assert len(got) == 18
    for (name, cat), ap in got.items():
        at = (rows.cat == cat).to_numpy()
        assert ap == pytest.approx(plain_ap(rows.y.to_numpy()[at], scores[name].to_numpy()[at]))


def test_logistic_is_at_its_minimum():
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(300, 6)), rng.random(300) + 0.5
    y = (x[:, 0] + rng.normal(size=300) > 0.3).astype(float)
    for free in (False, True):
        coef, intercept = train.newton_logistic(x, y, w, 0.7, free_intercept=free)
        miss = w * (1 / (1 + np.exp(-(x @ coef + intercept))) - y)
        assert np.abs(coef + 0.7 * (x.T @ miss)).max() < 1e-6
        assert abs((0.0 if free else intercept) + 0.7 * miss.sum()) < 1e-6


def test_balanced_model_takes_plain_features(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(5, 100, 500), rng.normal(0, 0.01, 500), np.full(500, 3.0)])
    y = (x[:, 0] / 100 + x[:, 1] * 100 + rng.normal(size=500) > 2).astype(int)
    rows = spark.createDataFrame([(i, i, int(t), v.tolist()) for i, (t, v) in enumerate(zip(y, x, strict=True))], "id1 bigint, id2 bigint, target int, x array<double>")
    tables.write_model(train.train_balanced(rows, F.col("x")), str(tmp_path / "m"), ["a", "b", "c"])
    model = tables.read_model(spark, str(tmp_path / "m"), ["a", "b", "c"])
    scaled = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
    coef, intercept = train.newton_logistic(scaled, y.astype(float), len(y) / (2 * np.bincount(y))[y], free_intercept=True)
    want = 1 / (1 + np.exp(-(scaled @ coef + intercept)))
    got = {r.id1: r.predict for r in models.probability(rows, model, F.col("x")).collect()}
    assert np.allclose([got[i] for i in range(500)], want, atol=1e-6)
    with pytest.raises(Exception, match="one class"):
        train.train_balanced(rows.filter("target = 1"), F.col("x")).collect()


@pytest.fixture
def lengths_encoder():
    # Made within, so that workers get it by value: they can't import this file.
    return lambda: lambda texts: np.array([[len("".join(t)), 1.0] for t in texts])


def test_encoder_sees_each_text_once_with_its_prefix(spark, lengths_encoder):
    asked = spark.createDataFrame([("abc",), ("abc",), ("",), (None,), ("z",)], "text string")
    got = {r.key: r.vector for r in encode(asked, lengths_encoder, prefix="q: ").collect()}
    assert set(got) == {"abc", "z"}
    assert got["abc"] == pytest.approx(np.array([6, 1]) / np.hypot(6, 1)) and got["z"] == pytest.approx(np.array([4, 1]) / np.hypot(4, 1))
    assert encode(asked.limit(0), lengths_encoder).collect() == []
    both = spark.createDataFrame([(0, 1, 2, "abc", "z"), (1, 3, 4, "", "z")], "row_idx bigint, id1 bigint, id2 bigint, text1 string, text2 string")
    scores = {r.row_idx: r.predict for r in pipeline.embed(both, encoder=lengths_encoder, prefix="q: ").collect()}
    assert scores[0] == pytest.approx(25 / np.hypot(6, 1) / np.hypot(4, 1)) and scores[1] == 0
    with pytest.raises(ValueError):
        pipeline.embed(both)


def test_batches_go_by_length_and_vectors_return_to_their_rows(spark, lengths_encoder):
    seen = []
    texts = ["aa", "b", "cccc", "ddd", ""]
    got = by_length(texts, np.array([len(t) for t in texts]), lambda some: seen.append(some) or [[len(t)] for t in some], 2)
    assert seen == [["cccc", "ddd"], ["aa", "b"], [""]] and got == [[2], [1], [4], [3], [0]]
    both = spark.createDataFrame([(1, "a", "bb"), (2, None, "c"), (3, "ddd", "")], "n int, text1 string, text2 string")
    assert {r.n: r.vector[0] for r in encode_pairs(both, lengths_encoder).collect()} == {1: 3, 2: 1, 3: 3}


def test_extrapolated_and_blend(spark):
    assert metrics.extrapolated(2.0, 10, 100, 20) == (20.0, True) and metrics.extrapolated(3.0, 10, 100, 20)[1] is False
    rows = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, 5.0), ("b", 9.0, 1.0)], "cat string, s double, r double")
    got = rows.select("cat", "s", sampling.rank_blend("s", "r", 0.5, "cat").alias("x")).collect()
    assert {(r.cat, r.s): r.x for r in got} == {("a", 1.0): 0.625, ("a", 2.0): 0.875, ("b", 9.0): 1.0}
