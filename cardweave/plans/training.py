"""Labelled pairs to models and reports; the commands of __main__ call this."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, sampling, train
from ..operators.features import NAMES, pair_features, vector
from ..operators.models import FALLBACK, forest_scores, linear_scores
from ..operators.pairs import attach, in_categories, used_items
from ..sources import tables
from ..sources.lineage import cut
from .pipeline import predict_scores

SPLITS = {
    "random": sampling.random_split,
    "id-tail": lambda rows, share, seed: sampling.tail_split(rows, share),
    "name-group": sampling.group_split,
}
BLENDS = (0.25, 0.50, 0.75)
#: Human labels' weights that the hybrid report compares.
HUMAN_WEIGHTS = (2.0, 5.0, 10.0)


def labelled_features(pairs: DataFrame, items: DataFrame, cache: str | None = None) -> DataFrame:
    """id1, id2, target, category, name1 and the features of pairs; with a cache, read from it or written to it."""
    columns = ["id1", "id2", "target", "category", "name1", *NAMES]
    if not cache:
        return cut(pair_features(pairs, items).select(*columns), "labelled")
    spark, n = pairs.sparkSession, pairs.count()
    found = tables.read_features(spark, cache, columns, n)
    if found is None:
        tables.write_features(pair_features(pairs, items).select(*columns), cache)
        found = tables.read_features(spark, cache, columns, n)
    return found


def split(rows: DataFrame, mode: str = "random", share: float = 0.2, seed: int = 2026) -> tuple[DataFrame, DataFrame]:
    """Rows to train on and rows to validate on."""
    if mode not in SPLITS:
        raise ValueError(f"unknown split {mode}; there are {', '.join(sorted(SPLITS))}")
    both = cut(SPLITS[mode](rows, share, seed), "split")
    return both.filter("not is_valid").drop("is_valid"), both.filter("is_valid").drop("is_valid")


def labels(rows: DataFrame) -> list[Column]:
    return [(F.col("target") >= 0.5).cast("int").alias("y"), F.col("category").alias("cat")]


def holdout_scores(fit: DataFrame, valid: DataFrame, c: float = 1.0) -> DataFrame:
    """(y, cat, text_tfidf, global, supervised) of valid: the cosine, and the margins of the fallback's model and of the
    categories' models."""
    fitted = cut(train.train_logistic(fit, vector(), c), "models")
    scored = linear_scores(valid, fitted, vector(), "supervised")
    scored = linear_scores(scored, fitted.filter(F.col("category") == FALLBACK), vector(), "global")
    return cut(scored.select(*labels(scored), "text_tfidf", "global", "supervised"), "holdout")


def holdout_report(scored: DataFrame) -> DataFrame:
    """(scorer, cat, ap) of holdout_scores() alone and of blends of their percentile ranks within a category."""
    names = ("text_tfidf", "global", "supervised")
    ranked = scored.withColumns({f"{n}_rank": sampling.rank_pct(n, "cat") for n in names})
    mixed = {
        f"supervised {w:.2f} {other}": w * F.col("supervised_rank") + (1 - w) * F.col(f"{other}_rank") for other in ("global", "text_tfidf") for w in BLENDS
    }
    return metrics.ap_of_scorers(ranked, {n: F.col(n) for n in names} | mixed)


def macro(report: DataFrame) -> DataFrame:
    """(scorer, macro_ap), the lowest first."""
    return report.groupBy("scorer").agg(F.avg("ap").alias("macro_ap")).orderBy("macro_ap", "scorer")


def write_linear(rows: DataFrame, path: str, c: float = 1.0) -> None:
    """A model table for the method `supervised`, the fallback's row last."""
    fitted = train.train_logistic(rows, vector(), c)
    tables.write_model(fitted.orderBy(F.col("category") == FALLBACK, "category"), path, NAMES)


def write_boosted(rows: DataFrame, path: str, **options) -> None:
    """forest and baseline under path, for the method `boosted`."""
    forest, baseline = train.train_boosting(rows, vector(), **options)
    tables.write_model(forest, f"{path}/forest", NAMES)
    tables.write_model(baseline, f"{path}/baseline", NAMES)


def compare(fit: DataFrame, valid: DataFrame, estimator: str = "hist", **options) -> DataFrame:
    """(cat, ap) on valid of one model a category: boosting (hist) or extra trees (extra)."""
    if estimator == "hist":
        scored = forest_scores(valid, *train.train_boosting(fit, vector(), fallback=False, **options), vector())
    elif estimator == "extra":
        scored = train.tree_scores(valid, train.train_trees(fit, vector(), **options), vector())
    else:
        raise ValueError(f"unknown estimator {estimator}; there are hist, extra")
    return metrics.ap_per_category(cut(scored.select(*labels(scored), F.col("predict").alias("s")), "compared"))


def soft_sample(pairs: DataFrame, items: DataFrame, block_rows: int, most: int = 20_000, seed: int = 2026) -> DataFrame:
    """Pairs within a block of items, at most so many of each block and category."""
    inside = tables.blocks(pairs, items.select("id", "row_idx"), block_rows)
    inside = attach(inside, items, {}, category="first")
    return sampling.at_most(inside, ["block", "category"], most, seed).select(*pairs.columns)


def hybrid_report(fit: DataFrame, valid: DataFrame, soft: DataFrame, **options) -> DataFrame:
    """(scorer, cat, ap) on valid of boosting by human labels, soft ones, confident soft ones, and soft and human ones
    together at each weight of the human ones."""
    soft = soft.select(*fit.columns)
    jobs = {"human": (fit, None), "soft": (soft, None), "soft confident": (train.confident(soft), None)}
    jobs |= {f"hybrid {w:g}": (train.hybrid_rows(fit, soft, w), "weight") for w in HUMAN_WEIGHTS}
    out = None
    for name, (rows, weight) in jobs.items():
        scored = forest_scores(valid, *train.train_boosting(rows, vector(), weight=weight, fallback=False, **options), vector())
        # A category without a model has no score: all its pairs tie.
        found = scored.select(*labels(scored), F.nanvl("predict", F.lit(0.0)).alias("s"), F.lit(name).alias("scorer"))
        out = found if out is None else out.unionByName(found)
    return metrics.ap_per_category(cut(out, "hybrid"), "scorer")


def evaluate(items: DataFrame, pairs: DataFrame, method: str = "tfidf", sample: int = 0, categories: str | None = None, seed: int = 1234, **options) -> tuple[DataFrame, float, int]:
    """((cat, ap) with the lowest first, seconds of scoring, number of pairs) of labelled pairs, or of about sample of them."""
    if categories:
        pairs = in_categories(pairs, items, categories)
    if sample and sample < pairs.count():
        pairs = sampling.stratified(attach(pairs, items, {}), "category", sample, seed).drop("category")
    pairs = cut(pairs, "pairs")
    items = cut(used_items(items, pairs), "items")
    began = time.perf_counter()
    scored = cut(predict_scores(pairs, items, method, **options), "scored")
    took, n = time.perf_counter() - began, scored.count()
    joined = scored.select("row_idx", F.col("predict").alias("s")).join(attach(pairs, items, {}), "row_idx")
    return metrics.ap_per_category(joined.select("s", *labels(joined))).orderBy("ap", "cat"), took, n
