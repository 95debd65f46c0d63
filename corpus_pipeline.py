"""From raw documents to packed sequences: each stage's output is written as Parquet and read as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame

from quartermill.llm import langid, neardup, packing, quality, substrings
from quartermill.llm.shared import cut

SHINGLE = 5  # words; four are only operator 3's query


def identified(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the identifier accepts."""
    return langid.accepted(docs)


def of_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by shingles of five words."""
    return neardup.one_of_each(docs, size=SHINGLE)


def trimmed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated 100-byte strings."""
    return substrings.without_repeats(docs)


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", identified), ("quality", of_quality), ("near_dedup", deduplicated), ("suffix_array_dedup", trimmed), ("packing", packed)]

#: Models, components and sequences are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}").df
    return STAGES[-1][1](spark, docs, sf_dir)
