"""Vectors of texts and of pairs by an encoder that the caller brings.

An encoder comes as a factory without arguments, called once in each task (there it picks its device and loads its
weights); what it returns takes a list of strings, or of pairs of strings, and gives an array of a vector for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: what the default encoder family wants before a text.
PREFIX = "query: "


def by_length(inputs: list, lengths: np.ndarray, encoder: Callable, size: int) -> list[list[float]]:
    """The vectors of inputs, in their order; those of like length are encoded together, the longest first."""
    order = np.argsort(-lengths, kind="stable")
    out: list = [None] * len(inputs)
    for at in range(0, len(order), size):
        some = order[at : at + size]
        for i, vector in zip(some, np.asarray(encoder([inputs[i] for i in some]), np.float32), strict=True):
            out[i] = vector.tolist()
    return out


def encode(texts: DataFrame, factory: Callable, prefix: str = PREFIX, size: int = 256) -> DataFrame:
    """(key, vector) of each distinct text of texts (text) that isn't empty or null, scaled to length 1."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = factory()
        for part in parts:
            keys = part.text.tolist()
            found = by_length([prefix + t for t in keys], part.text.str.len().to_numpy(), encoder, size)
            scaled = [(v / max(float(np.linalg.norm(v)), 1e-12)).tolist() for v in map(np.array, found)]
            yield pd.DataFrame({"key": keys, "vector": scaled})

    return texts.select("text").filter("text <> ''").distinct().mapInPandas(run, "key string, vector array<float>")


def encode_pairs(pairs: DataFrame, factory: Callable, size: int = 32) -> DataFrame:
    """pairs (text1, text2, …) with the vector that a cross-encoder gives for both texts together; null texts are empty."""
    schema = pairs.withColumn("vector", F.lit(None).cast("array<float>")).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = factory()
        for part in parts:
            first, second = part.text1.fillna(""), part.text2.fillna("")
            lengths = (first.str.len() + second.str.len()).to_numpy()
            yield part.assign(vector=by_length(list(zip(first, second, strict=True)), lengths, encoder, size))

    return pairs.mapInPandas(run, schema)
