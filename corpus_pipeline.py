"""A training corpus from documents: languages, near-duplicates, repeated passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir), is written as Parquet and reread as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vereda.llm import bpe, catalog, langid, mixing, nearcopies, substrings
from vereda.llm.common import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (NULL text, no letter) go."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id."""
    return nearcopies.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that an earlier document has are cut out."""
    return substrings.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to their source's target weight and shuffled."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids of each document, in the order of the mixture."""
    return bpe.tokens(docs, *catalog.public_vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: Language identification, near-duplicates and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.put(name, stage(spark, docs, sf_dir))
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
