"""Frozen models over a stream of pairs: cards and models are static, so scoring is a stateless stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import NAMES, joined, structured, vector
from ..operators.models import forest_scores


def score_stream(pairs: DataFrame, items: DataFrame, forest: DataFrame, baseline: DataFrame) -> DataFrame:
    """(id1, id2, predict) of streamed pairs by a forest on the features that need no corpus; the two TF-IDF features,
    which are fitted on a whole run, are 0."""
    rows = structured(joined(pairs, items)).withColumns({n: F.lit(0.0) for n in NAMES[36:]})
    return forest_scores(rows, forest, baseline, vector()).select("id1", "id2", "predict")
