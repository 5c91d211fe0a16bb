"""Exact nearest-vector search under four metrics.

Work is split over corpus partitions. Each task scores its Arrow batches
against the question block with one matrix product, keeps the best k per
question (and per branch) as it goes, and ships only those rows; a windowed
top-k over the survivors finishes the job. The corpus itself is never shuffled
or copied, and no pair list is ever written. More questions than a block holds
make more passes over the corpus, all alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import embed

METRICS = ("cosine", "l2", "l1", "ip")
# Questions of a block, which is shipped to every task.
BROADCAST_QUESTIONS = 2048
DIGITS = 4


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column])


def score_block(block: np.ndarray, questions: np.ndarray, metric: str) -> np.ndarray:
    """rows x questions; larger is better for cosine, distances otherwise."""
    if metric == "cosine":
        bn, qn = np.linalg.norm(block, axis=1), np.linalg.norm(questions, axis=1)
        scale = np.outer(bn, qn)
        dots = block @ questions.T
        return np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)
    if metric == "ip":
        return -(block @ questions.T)
    out = np.empty((len(block), len(questions)))
    for j, q in enumerate(questions):
        diff = block - q
        out[:, j] = np.sqrt((diff * diff).sum(axis=1)) if metric == "l2" else np.abs(diff).sum(axis=1)
    return out


def best_rows(ids, groups, keys, k: int | None) -> np.ndarray:
    """Positions of the k smallest keys per group; ties go to the smaller id."""
    if k is None:
        return np.arange(len(keys))
    if groups is None and len(keys) > 4 * k:
        cut = np.partition(keys, k - 1)[k - 1]
        pool = np.flatnonzero(keys <= cut)
    else:
        pool = np.arange(len(keys))
    if groups is None:
        order = np.lexsort((ids[pool], keys[pool]))
        return pool[order[:k]]
    order = pool[np.lexsort((ids[pool], keys[pool], groups[pool]))]
    g = groups[order]
    starts = np.r_[True, g[1:] != g[:-1]]
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(starts, np.arange(len(g)), 0))
    return order[rank < k]


class _Running:
    """Best rows seen so far in one task, per question."""

    def __init__(self, k, grouped, ascending, digits):
        self.k, self.grouped, self.ascending, self.digits = k, grouped, ascending, digits
        self.parts: dict = {}

    def add(self, qids, ids, groups, scores):
        scores = np.round(scores, self.digits) + 0.0
        keys = scores if self.ascending else -scores
        for j, qid in enumerate(qids):
            keep = best_rows(ids, groups, keys[:, j], self.k)
            part = (ids[keep], None if groups is None else groups[keep], scores[keep, j])
            if qid in self.parts and self.k is not None:
                old = self.parts[qid]
                part = tuple(None if a is None else np.concatenate([a, b]) for a, b in zip(old, part))
                key = part[2] if self.ascending else -part[2]
                again = best_rows(part[0], part[1], key, self.k)
                part = tuple(None if a is None else a[again] for a in part)
            self.parts[qid] = part
        if self.k is None:
            return self.flush()
        return None

    def flush(self) -> pd.DataFrame | None:
        frames = []
        for qid, (ids, groups, scores) in self.parts.items():
            cols = {"query_id": qid, "id": ids, "score": scores}
            if self.grouped:
                cols["grp"] = groups
            frames.append(pd.DataFrame(cols))
        self.parts = {}
        return pd.concat(frames, ignore_index=True) if frames else None


def run_scored(corpus: DataFrame, payload: str, questions: DataFrame, prepare, score, *,
               k: int | None, ascending: bool, group: str | None = None,
               digits: int = DIGITS, bound: int = BROADCAST_QUESTIONS) -> DataFrame:
    """Shared driver of every scored search.

    `corpus` has `id`, `payload` and optionally `group`. `questions` has
    `query_id` plus whatever `prepare(pandas)` turns into the object that
    `score(payload_series, prepared)` takes; `score` returns rows x questions.
    The result has query_id, id, score and, if grouped, grp.
    """
    grouped = group is not None
    cols = [F.col("id"), F.col(payload).alias("payload")]
    if grouped:
        cols.append(F.col(group).alias("grp"))
    corpus = corpus.select(*cols)
    id_type = corpus.schema["id"].dataType.simpleString()
    q_type = questions.schema["query_id"].dataType.simpleString()
    schema = f"query_id {q_type}, id {id_type}, score double"
    if grouped:
        schema += f", grp {corpus.schema['grp'].dataType.simpleString()}"
    def local(head: pd.DataFrame) -> DataFrame:
        """The corpus against one block of questions, which travels in the task closure; the corpus stays put."""
        qids, prepared = list(head["query_id"]), prepare(head)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = _Running(k, grouped, ascending, digits)
            for pdf in batches:
                for start, stop in embed.spans(pdf["payload"]) if qids else ():
                    part = pdf.iloc[start:stop]
                    out = best.add(qids, part["id"].to_numpy(), part["grp"].to_numpy() if grouped else None,
                                   score(part["payload"], prepared))
                    if out is not None:
                        yield out
            out = best.flush()
            if out is not None:
                yield out

        return corpus.mapInPandas(run, schema)

    # One block is the usual case; more are dealt by hash, and each reads the corpus once.
    head = questions.limit(bound + 1).toPandas()
    if len(head) <= bound:
        return local(head)
    blocks = -(-questions.count() // bound)
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [local(questions.filter(number == b).toPandas()) for b in range(blocks)])


def top(scored: DataFrame, k: int, *, ascending: bool, by=("query_id",), rank: str = "rank") -> DataFrame:
    """Final top-k of the partial results, ids breaking ties."""
    order = F.col("score").asc() if ascending else F.col("score").desc()
    w = Window.partitionBy(*by).orderBy(order, F.col("id").asc())
    return scored.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def search(corpus: DataFrame, questions: DataFrame, k: int, metric: str = "cosine", *,
           vector: str = "embedding", group: str | None = None, digits: int = DIGITS,
           bound: int = BROADCAST_QUESTIONS) -> DataFrame:
    """k nearest corpus rows per question (per branch when `group` is given).

    corpus: id, `vector`[, `group`]; questions: query_id, `vector`.
    Score is the cosine similarity, or the distance for the other metrics.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    ascending = metric != "cosine"
    # Rows without a vector have no distance and are no candidates.
    corpus, questions = corpus.filter(F.col(vector).isNotNull()), questions.filter(F.col(vector).isNotNull())
    scored = run_scored(
        corpus, vector, questions.select("query_id", F.col(vector).alias("qvec")),
        prepare=lambda q: _matrix(q["qvec"]),
        score=lambda payload, q: score_block(_matrix(payload), q, metric),
        k=k, ascending=ascending, group=group, digits=digits, bound=bound)
    by = ("query_id", "grp") if group else ("query_id",)
    return top(scored, k, ascending=ascending, by=by)


def branch_then_global(corpus: DataFrame, questions: DataFrame, k: int, group: str, *,
                       per_branch: int | None = None, **kw) -> DataFrame:
    """Top-k inside every branch, then the k best of those."""
    branch = search(corpus, questions, per_branch or k, group=group, **kw)
    return top(branch.drop("rank"), k, ascending=kw.get("metric", "cosine") != "cosine")


def collection_k(k: int, n: int) -> int:
    """Candidates each of n collections contributes to a global top-k."""
    return max(2, -(-k // max(1, n)) + 1)


def keyword_k(k: int, m: int) -> int:
    """Candidates each of m keywords contributes to a global top-k."""
    return max(2, -(-k // m)) + 1


def similarity_matrix(left: DataFrame, right: DataFrame, vector: str = "embedding",
                      digits: int = DIGITS) -> DataFrame:
    """Every similarity between two sets, as (query_id, id, score).

    The output is the product of both sides, so this is for small sets such as
    one prototype per source; use `search` for corpora. Rows without a vector are left out.
    """
    left, right = left.filter(F.col(vector).isNotNull()), right.filter(F.col(vector).isNotNull())
    return run_scored(
        left, vector, right.select("query_id", F.col(vector).alias("qvec")),
        prepare=lambda q: _matrix(q["qvec"]),
        score=lambda payload, q: score_block(_matrix(payload), q, "cosine"),
        k=None, ascending=False, digits=digits)


def prototypes(vectors: DataFrame, key: str, vector: str = "embedding", digits: int = 6) -> DataFrame:
    """Mean vector per key, rounded: partial sums per dimension, no vector shuffle."""
    mean = (vectors.select(key, F.posexplode(vector).alias("dim", "x"))
            .groupBy(key, "dim").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("m")))
    return (mean.groupBy(key)
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias(vector)))


def cosine(a, b):
    """Cosine of two array columns, 0 when either norm is 0."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))

    def total(arr):
        return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    na = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))
    nb = F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot / (na * nb))
