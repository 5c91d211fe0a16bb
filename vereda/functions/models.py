"""Interfaces of the external models, with stand-ins that need none."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Scorer(Protocol):
    def predict(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class EchoGenerator:
    """Returns the end of each prompt; for tests."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [p[-200:] for p in prompts]


def generate(df: DataFrame, key: str, prompt: str, model: Generator, out: str = "answer") -> DataFrame:
    """(key, out) from a generator run on Arrow batches."""
    src = df.select(key, F.col(prompt).alias("prompt"))
    schema = f"{key} {src.schema[key].dataType.simpleString()}, {out} string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], out: model.generate(pdf["prompt"].tolist())})

    return src.mapInPandas(run, schema)


def model_score(model: Scorer):
    """A rerank score column function from a pair scorer."""
    @F.pandas_udf("double")
    def score(question: pd.Series, document: pd.Series) -> pd.Series:
        return pd.Series(model.predict(list(zip(question, document)))).astype(float)

    return score


def keyword_prompt(question, limit: int = 5):
    """Prompt asking a generator for search keywords."""
    return F.concat(F.lit(f"Liste até {limit} palavras-chave de busca, separadas por vírgula, para: "), question)


def parse_keywords(reply, limit: int = 5):
    """Distinct non-empty keywords of a comma- or line-separated reply."""
    parts = F.transform(F.split(reply, r"[,;\n]"), lambda x: F.trim(F.regexp_replace(x, r"^[\s\-*\d.]+|[\s.\"']+$", "")))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: x != "")), F.lit(1), F.lit(limit))


__all__ = ["Generator", "Scorer", "EchoGenerator", "generate", "model_score", "keyword_prompt", "parse_keywords"]
