"""From documents to token ids: reject low quality, fold exact and near copies, mix the sources, encode.

Each stage reads what the stage before has written. All but the last return the columns of documents as they came, columns of
other names included, whatever those names are.

In every stage a null text counts as empty, and empty and very long texts are taken whole; an empty table gives an empty
table. What a stage does with nulls in other columns, repeated rows and ties is told where it is defined below.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality_classifier
from tidemark.llm.common import table
from tidemark.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier learned from the labels doesn't reject.

    A score depends on the text alone, so repeated rows stay or go together and no other null matters; a score of 0.5 stays.
    Of a labelled id with several texts, one is learned: the one whose hash is least.
    """
    return quality_classifier.good_documents(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest id. A null id is the smallest; of repeated rows one stays."""
    return exact_dedup.deduplicated(docs, exact_dedup.earlier_half(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, a null id only where all are null; of
    repeated rows one stays. Documents without words are linked with nothing and stay."""
    return near_dedup.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it. A null source is a source of its own; repeated rows count each; ties
    in the random order are broken by id and size. Documents without words can't be taken."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text: one row for each row."""
    ranks = byte_bpe.sent_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.round_trip(docs, ranks, with_ids=True)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: The classifier can't be expressed in SQL; tests/llm/test_pipeline.py has a version by plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
