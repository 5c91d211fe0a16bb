"""Embedding interface and a deterministic stand-in for tests.

A real model is plugged in as a `Embedder`: any callable from a list of texts
to a list of unit vectors, run on Arrow batches next to the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

DIMS = 64
BATCH = 100
# Rows, and characters or components of their values, that a task works on at a time; they bound memory, not results.
HELD_ROWS, HELD_CHARS = 2048, 1 << 21


class Embedder(Protocol):
    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...


def spans(values) -> Iterator[tuple[int, int]]:
    """(start, stop) of consecutive pieces of at most HELD_ROWS values and, unless one alone is longer, HELD_CHARS in all."""
    start = held = 0
    for i, x in enumerate(values):
        if i > start and (i - start >= HELD_ROWS or held + len(x) > HELD_CHARS):
            yield start, i
            start, held = i, 0
        held += len(x)
    if len(values) > start:
        yield start, len(values)


class _Slots(dict):
    """The hashed slot of each token seen, up to a number."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[token] = slot = int(hashlib.md5(token.encode()).hexdigest()[:2], 16)
        return slot


_SLOTS = _Slots()


def vectors(token_lists, dims: int = DIMS) -> np.ndarray:
    """Unit bag-of-words vectors: each token adds one to a hashed slot."""
    sizes = [len(x) for x in token_lists]
    slots = np.fromiter((_SLOTS[t] for toks in token_lists for t in toks), np.int64, sum(sizes)) % dims
    cell = np.repeat(np.arange(len(sizes)), sizes) * dims + slots
    out = np.bincount(cell, minlength=len(sizes) * dims).astype(np.float64).reshape(len(sizes), dims)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0)


def embed(df: DataFrame, text: str, dims: int = DIMS, key: str = "id") -> DataFrame:
    """`key` and `embedding` from the hashing embedder."""
    src = df.select(key, F.array_join(T.tokens(F.col(text)), " ").alias("toks"))
    schema = f"{key} {src.schema[key].dataType.simpleString()}, embedding array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start, stop in spans(pdf["toks"]):
                part = pdf.iloc[start:stop]
                yield pd.DataFrame({key: part[key], "embedding": list(vectors([x.split(" ") if x else [] for x in part["toks"]], dims))})

    return src.mapInPandas(run, schema)


def embed_with(df: DataFrame, text: str, model: Embedder, key: str = "id", batch: int = BATCH,
               retries: int = 3, pause: float = 0.0) -> DataFrame:
    """Embed with a model in batches. The rows of a batch that keeps failing have a NULL vector and the error."""
    import time
    src = df.select(key, F.col(text).alias("text"))
    schema = f"{key} {src.schema[key].dataType.simpleString()}, embedding array<double>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at:at + batch]
                for attempt in range(retries):
                    try:
                        vecs = model.embed_documents(part["text"].tolist())
                    except Exception as exc:  # any failure of the model is reported with the row
                        failed = f"{type(exc).__name__}: {exc}"
                        time.sleep(pause * 2 ** attempt)
                        continue
                    yield pd.DataFrame({key: part[key].to_numpy(), "embedding": [list(map(float, v)) for v in vecs], "error": None})
                    break
                else:
                    yield pd.DataFrame({key: part[key].to_numpy(), "embedding": None, "error": failed})

    return src.mapInPandas(run, schema)


def check_dimension(df: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has another length; an empty result means the schema holds."""
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) != dims))
