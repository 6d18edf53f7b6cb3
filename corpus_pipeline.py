"""A training corpus from raw documents: five stages, each written and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hourgrid.llm import bpe, line_dedup, near_dup, tiling, toxicity
from hourgrid.llm.common import vocabulary_path
from hourgrid.sources.scratch import store

LINKED_FROM = Fraction(8, 10)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels outside the held-out quarter, doesn't reject."""
    labels = toxicity.labels_to_learn(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier place has, or has but for a word; those left without lines go."""
    return line_dedup.drop_duplicate_lines(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose word shingles link them at a similarity of 0.8 or more, the one of the smallest id."""
    return near_dup.keep_representatives(docs, LINKED_FROM)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than half of the words of any benchmark item."""
    return tiling.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each document."""
    return bpe.round_trip(docs, vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("near duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("byte-level BPE", encoded),
]

# Greedy tiling, training and merging by rank have no SQL form; a brute-force version stands in for it in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
