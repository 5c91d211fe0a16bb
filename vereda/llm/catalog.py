"""The registered queries of this package, and their SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, bpe, fingerprints, langid, minhash, mixing, quality, runs, sharding, simhash, substrings, wrappers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _over(table: str, name: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    if sql is not None:
        ORACLES[name] = sql


def public_vocabulary() -> tuple[str, str]:
    """Path and pattern of the tokenizer that the query is to use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def token_sides() -> tuple[Callable, Callable]:
    """How executors open the two tokenizers that the query aligns."""
    import public_tokenizers

    a, b, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
    return lambda: alignment.byte_level(a, pattern), lambda: alignment.pieces(b)


_over("documents", "op1_langid", langid.digest)
_over("documents", "op2_fingerprints", fingerprints.digest)
_over("documents", "op3_mixing", mixing.digest, mixing.ORACLE)
_over("documents", "op4_substrings", substrings.digest)
_over("documents", "op5_bpe", lambda docs: bpe.digest(docs, *public_vocabulary()))
_over("pages", "op6_wrappers", wrappers.main_text)
QUERIES["op7_quality"] = lambda spark, sf_dir: quality.digest(
    *(spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in ("documents", "labels")))
_over("documents", "op8_sharding", sharding.digest)
_over("documents", "op9_simhash", simhash.digest)
_over("embeddings", "op10_ann", ann.digest)
_over("documents", "op11_minhash", minhash.digest)
_over("documents", "op12_runs", runs.digest)
_over("documents", "op13_alignment", lambda docs: alignment.counted(docs, *token_sides()))
