"""From raw documents to packed training windows: each stage is one of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import jaccard_join, packing, quality_cnn, quality_rules
from folioflow.llm.common import drop_scratch, stored, table
from folioflow.llm.queries import END_ID, WORD_BPE


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network predicts to be good."""
    return quality_cnn.accepted(docs, table(spark, sf_dir, "labels"))


def risk_controlled_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test and the risk-controlled rules keep."""
    return quality_rules.accepted(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, a similarity of 0.8 or more."""
    return jaccard_join.without_copies(docs, shingle=5, percent=80)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in windows."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_BPE), END_ID)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", risk_controlled_rules),
    ("n-gram Jaccard join", near_copies),
    ("packing", windows),
]

#: Trained weights, set similarity by hashing and tokenizing are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs = stored(made)
        drop_scratch(made)  # the stage's own copies, and the table of the stage before
    return STAGES[-1][1](spark, docs, sf_dir)
