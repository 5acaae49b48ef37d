"""Cards and pairs in, one score for each pair out, in the order of the pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encoder import PREFIX, encode
from ..operators.features import NAMES, pair_features, vector
from ..operators.models import embedding_scores, forest_scores, linear_scores
from ..operators.pairs import missing_text, with_texts
from ..operators.tfidf import tfidf, tfidf_wc
from ..sources import tables
from ..sources.lineage import cut, uncut


def embed(pairs: DataFrame, vectors: DataFrame | None = None, encoder: Callable | None = None, prefix: str = PREFIX) -> DataFrame:
    """Scores by vectors (key: the text, vector: an encoder's normalised output), or by those that an encoder's factory
    gives: each distinct text is encoded once."""
    if vectors is None:
        if encoder is None:
            raise ValueError("embed needs vectors of the texts or an encoder: none is included")
        vectors = cut(encode(pairs.select(F.col("text1").alias("text")).union(pairs.select("text2")), encoder, prefix), "vectors")
    return embedding_scores(pairs.withColumns({"key1": F.col("text1"), "key2": F.col("text2")}), vectors).drop("key1", "key2")


SCORERS: dict[str, Callable[..., DataFrame]] = {"tfidf": tfidf, "tfidf_wc": tfidf_wc, "embed": embed}


def scorer(name: str) -> Callable[..., DataFrame]:
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name}; there are {', '.join(sorted(SCORERS))}")
    return SCORERS[name]


def predict_scores(pairs: DataFrame, items: DataFrame, method: str = "tfidf", models: DataFrame | None = None, baseline: DataFrame | None = None, **options) -> DataFrame:
    """(row_idx, id1, id2, predict): supervised and boosted take a model table and give raw margins, with 0 for pairs
    that miss a text; other methods are scorers of texts."""
    if method in ("supervised", "boosted"):
        rows = pair_features(pairs, items)
        if method == "supervised":
            scored = linear_scores(rows, models, vector())
        else:
            scored = forest_scores(rows, models, baseline, vector())
        scored = scored.withColumn("predict", F.when(missing_text(), 0.0).otherwise(F.col("predict")))
    else:
        score = scorer(method)
        # These read an item's text once, not with each pair.
        scored = score(pairs, items=items, **options) if score in (tfidf, tfidf_wc) else score(with_texts(pairs, items), **options)
    return scored.select("row_idx", "id1", "id2", "predict")


def predict_pipeline(spark: SparkSession, items_path: str, matches_path: str, output_path: str, method: str = "tfidf", model_path: str | None = None) -> int:
    """Scores a file of pairs into one CSV; the number of rows, which is that of the pairs."""
    items, pairs = tables.load_items(spark, items_path), tables.load_pairs(spark, matches_path)
    models = baseline = None
    if method == "supervised":
        models = tables.read_model(spark, model_path, NAMES)
    elif method == "boosted":
        models, baseline = tables.read_model(spark, f"{model_path}/forest", NAMES), tables.read_model(spark, f"{model_path}/baseline", NAMES)
    scored = predict_scores(pairs, items, method, models, baseline)
    scored = cut(scored, "scored")
    n, expected = scored.count(), pairs.count()
    if n != expected:
        raise RuntimeError(f"{n} scores for {expected} pairs")
    tables.write_submission(scored, output_path)
    uncut(scored)
    return n
