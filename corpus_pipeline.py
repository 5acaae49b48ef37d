"""A training corpus from documents: toxic texts go, copies and near copies go, sources are mixed, texts encoded."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cardweave.llm import bpe, exact_dedup, mixing, simhash, toxicity
from cardweave.llm.common import batches
from cardweave.llm.registry import TOKENIZERS, table
from cardweave.sources.lineage import cut, remove, scratch, temporary


# Each stage takes documents with nulls in any column, empty, very long and repeated texts, and an empty table, and
# keeps extra columns; what becomes of them is said at the operator that it calls.


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from the labelled ones, doesn't reject; without labels, by the default one."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; texts without words are one group."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints."""
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents by output shard; a document that it takes again has a row for each
    time, one without words has none."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document of the mix, their number and the digests of ids and decoded text. They are written here:
    executors that the stages before have filled hold the tokenizer besides small batches only."""
    with batches(spark, 500):
        return cut(bpe.digests(bpe.round_trip(docs, f"{TOKENIZERS}/word_bpe_49k.json")), "encoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash", without_near_copies),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Learned scores, fingerprints, the mix and ids aren't expressible in SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written to the shared folder and read again by the next. What a stage leaves
    besides, and the table before it, are removed once it's written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{scratch(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
