"""A corpus from raw documents: quality rules, exact and near duplicates, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marketpulse.llm import exact_dedup, mixing, ngram_join, packing, quality
from marketpulse.llm.common import table
from marketpulse.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio to the labelled good ones."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels").where("quality = 1"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts."""
    return ngram_join.without_similar(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by the weights of their sources, in training order."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    # Workers outlive the stage: they remember fewer words, for the stages of a later run.
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), known=200_000)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", mixture),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "corpus")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Hashes, MinHash and a tokenizer have no SQL; ``tests/llm/test_pipeline.py`` checks the stages by brute force.
ORACLE_SQL = None
