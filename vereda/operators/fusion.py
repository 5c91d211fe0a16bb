"""Fusing, gating and selecting ranked results. All inputs are short top-k lists."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import embed, text as T
from . import lexical, nearest

# Fixed values.
RRF_K = 60
RELEVANCE_THRESHOLD = 0.20
SOURCE_SHARE = 0.85
FIRST_CHARS = 150


def rrf(rankings: list[tuple[DataFrame, float]], content: str = "id", digits: int = 6,
        k: int | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of (query_id, `content`, rank) lists.

    Equal content is merged; the result may exceed the k of the inputs.
    """
    parts = [df.select("query_id", content, F.lit(float(w)).alias("w"), "rank") for df, w in rankings]
    fused = (reduce(DataFrame.unionByName, parts)
             .groupBy("query_id", content)
             .agg(F.round(F.sum(F.col("w") / (F.col("rank") + RRF_K)), digits).alias("score")))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(content).asc())
    out = fused.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= k) if k else out


def hybrid(docs: DataFrame, questions: DataFrame, *, alpha: float = 0.5, k: int = 5,
           dims: int = embed.DIMS) -> DataFrame:
    """BM25 and vector top-k of the same questions, fused by reciprocal rank."""
    lex = lexical.search(docs, questions, k)
    sem = nearest.search(embed.embed(docs, "text", dims), embed.embed(questions, "text", dims, key="query_id"), k,
                         digits=6)
    return rrf([(lex, round(1 - alpha, 2)), (sem, round(alpha, 2))])


def linear_hybrid(docs: DataFrame, questions: DataFrame, *, alpha: float = 0.5, k: int = 3,
                  dims: int = embed.DIMS, digits: int = 6) -> DataFrame:
    """Min-max scaled cosine plus max-scaled BM25.

    The scales come from three top-1 searches; a second pass ranks the sum.
    """
    qv = embed.embed(questions, "text", dims, key="query_id")
    dv = embed.embed(docs, "text", dims)
    hi = nearest.search(dv, qv, 1, digits=12).select("query_id", F.col("score").alias("hi"))
    lo = _lowest(dv, qv).select("query_id", F.col("score").alias("lo"))
    top_lex = lexical.search(docs, questions, 1, tokenizer=T.tokens, digits=12).select(
        "query_id", F.col("score").alias("lex_max"))
    stats, df = lexical.statistics(docs, tokenizer=T.tokens)
    weighted = (lexical.weigh(questions, df, stats, "text", T.tokens)
                .join(qv, "query_id").join(hi, "query_id").join(lo, "query_id").join(top_lex, "query_id"))
    payload = docs.select("id", F.array_join(T.tokens("text"), " ").alias("toks"))

    def prepare(q):
        return {"lex": lexical.term_matrix(q["terms"]), "vec": nearest._matrix(q["embedding"]),
                "lo": q["lo"].to_numpy(), "hi": q["hi"].to_numpy(),
                "max": np.where(q["lex_max"].to_numpy() == 0, 1.0, q["lex_max"].to_numpy())}

    def score(payload, p):
        payload = [x.split(" ") if x else [] for x in payload]
        vecs = embed.vectors(payload, dims)
        sem = (nearest.score_block(vecs, p["vec"], "cosine") - p["lo"]) / (p["hi"] - p["lo"] + 1e-8)
        return alpha * sem + (1 - alpha) * lexical.score_tokens(payload, p["lex"], stats) / p["max"]

    return nearest.top(nearest.run_scored(payload, "toks", weighted, prepare, score, k=k,
                                          ascending=False, digits=digits), k, ascending=False)


def _lowest(dv: DataFrame, qv: DataFrame) -> DataFrame:
    scored = nearest.run_scored(
        dv, "embedding", qv.select("query_id", F.col("embedding").alias("qvec")),
        prepare=lambda q: nearest._matrix(q["qvec"]),
        score=lambda payload, q: nearest.score_block(nearest._matrix(payload), q, "cosine"),
        k=1, ascending=True, digits=12)
    return nearest.top(scored, 1, ascending=True)


def rerank(candidates: DataFrame, score: Column, k: int, digits: int = 4) -> DataFrame:
    """Second-stage ranking of each question's candidates by `score`."""
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("rank").asc())
    return (candidates.withColumn("rerank_score", F.round(score, digits))
            .withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= k))


def gate(results: DataFrame, threshold: float = RELEVANCE_THRESHOLD) -> DataFrame:
    """Per question: best score and whether it clears the relevance threshold."""
    return results.groupBy("query_id").agg(F.max("score").alias("best")).withColumn(
        "decision", F.when(F.col("best") >= threshold, "answer").otherwise("fallback"))


def select_sources(results: DataFrame, share: float = SOURCE_SHARE, source: str = "source") -> DataFrame:
    """Sources whose best score is within `share` of the question's best."""
    per = results.groupBy("query_id", source).agg(F.max("score").alias("score"))
    best = per.groupBy("query_id").agg(F.max("score").alias("best"))
    return per.join(best, "query_id").filter(F.col("score") >= F.col("best") * share).drop("best")


def cites(answer, title) -> Column:
    """At least half (and one) of the title's long words occur in the answer."""
    low = F.lower(T._col(answer))
    long_words = F.filter(T.words(F.lower(T._col(title))), lambda w: F.length(w) > 3)
    found = F.size(F.filter(long_words, lambda w: F.contains(low, w)))
    need = F.greatest(F.lit(1), F.floor(F.size(long_words) / 2))
    return (F.size(long_words) > 0) & (found >= need)


def first_seen_per_prefix(results: DataFrame, text: str, order: list[Column], k: int,
                          chars: int = FIRST_CHARS) -> DataFrame:
    """Merge per-keyword lists: the first-seen row per text prefix keeps its score.

    Output is the global top-k of the survivors, by score then id.
    """
    row = F.struct(F.struct(*order).alias("o"), F.struct(*[F.col(c) for c in results.columns]).alias("r"))
    kept = results.groupBy(F.left(F.col(text), F.lit(chars)).alias("prefix")).agg(F.min(row).alias("m"))
    return (kept.select("m.r.*").orderBy(F.col("score").desc(), F.col("id").asc()).limit(k))
