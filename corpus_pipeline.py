"""A corpus pipeline of four stages over the table documents: quality, near duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quorumlake.llm import bpe, mixing, near_texts, quality
from quorumlake.llm.common import scratch
from quorumlake.llm.queries import table, vocabulary, word_pattern


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that importance resampling towards labelled good text leaves out go."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2 on five-word shingles: of each class of near copies the document of smallest id stays."""
    return near_texts.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: each document comes as often as the mix of sources takes it."""
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token ids instead of texts, with digests of the ids and of what they decode to."""
    return bpe.encode_texts(docs, path=vocabulary("byte_bpe_multi_50k.tiktoken"), pattern=word_pattern())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_dedup),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: The models, fingerprints and token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            to = scratch(spark, f"stage{i}")
            docs.write.parquet(to)
            docs = spark.read.schema(docs.schema).parquet(to)
    return docs
