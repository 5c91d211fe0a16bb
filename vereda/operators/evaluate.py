"""Retrieval and answer quality metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import text as T


def mrr(results: DataFrame, questions: DataFrame, hit: Column, k: int, digits: int = 4) -> DataFrame:
    """MRR, hit recall and precision over the returned rows, averaged over questions.

    results: query_id, rank and whatever `hit` reads; questions: query_id.
    Recall is 1 when anything hits; precision divides by the rows returned.
    """
    per = results.filter(F.col("rank") <= k).groupBy("query_id").agg(
        F.min(F.when(hit, F.col("rank"))).alias("first"), F.count_if(hit).alias("hits"), F.count("*").alias("n"))
    full = questions.select("query_id").join(per, "query_id", "left")
    return full.agg(
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), digits).alias("mrr"),
        F.round(F.avg(F.when(F.coalesce("hits", F.lit(0)) > 0, 1.0).otherwise(0.0)), digits).alias("recall_at_k"),
        F.round(F.avg(F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0))), digits).alias("precision_at_k"),
        F.count("*").alias("n_queries")).withColumn("k", F.lit(k))


def text_hit(relevant, found) -> Column:
    """Either text contains the other, ignoring case."""
    a, b = F.lower(T._col(relevant)), F.lower(T._col(found))
    return F.contains(b, a) | F.contains(a, b)


def recall_precision(results: DataFrame, relevant: DataFrame, k: int, digits: int = 4) -> DataFrame:
    """Per question recall = hits / relevant and precision = hits / k.

    results: query_id, id, rank; relevant: query_id, id. Questions come from
    either side; without relevant rows both values are 0.
    """
    rel = relevant.select("query_id", "id").distinct()
    hits = results.filter(F.col("rank") <= k).join(rel, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    total = rel.groupBy("query_id").agg(F.count("*").alias("relevant"))
    everyone = results.select("query_id").union(rel.select("query_id")).distinct()
    j = everyone.join(hits, "query_id", "left").join(total, "query_id", "left").na.fill(0, ["hits", "relevant"])
    recall = F.when(F.col("relevant") == 0, F.lit(0.0)).otherwise(F.col("hits") / F.col("relevant"))
    precision = F.lit(0.0) if k == 0 else F.col("hits") / F.lit(k)
    return j.select("query_id", "hits", "relevant", F.round(recall, digits).alias("recall"), F.round(precision, digits).alias("precision"))


# --- ROUGE-L -------------------------------------------------------------------


def rouge_tokens(c) -> Column:
    """Lower-case runs of [a-z0-9]; other letters separate tokens."""
    return F.filter(F.split(F.lower(F.coalesce(T._col(c), F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence, one vector step per token of `a`."""
    if len(a) > len(b):
        a, b = b, a
    codes: dict[str, int] = {}
    bn = np.array([codes.setdefault(t, len(codes)) for t in b], dtype=np.int64)
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for t in a:
        code = codes.get(t)
        if code is None:
            continue
        step = row[1:].copy()
        same = bn == code
        step[same] = row[:-1][same] + 1
        row[1:] = np.maximum.accumulate(step)
    return int(row[-1])


@F.pandas_udf(IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) for x, y in zip(a, b)])


def rouge_l(pairs: DataFrame, predicted: str, reference: str, digits: int = 4) -> DataFrame:
    """Add precision, recall and F1 of ROUGE-L to each (predicted, reference) row."""
    p = pairs.withColumn("__a", rouge_tokens(predicted)).withColumn("__b", rouge_tokens(reference)).withColumn("__l", lcs("__a", "__b"))
    prec = F.when(F.size("__a") > 0, F.col("__l") / F.size("__a")).otherwise(F.lit(0.0))
    rec = F.when(F.size("__b") > 0, F.col("__l") / F.size("__b")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return (p.withColumn("rouge_p", F.round(prec, digits)).withColumn("rouge_r", F.round(rec, digits))
            .withColumn("rouge_f1", F.round(f1, digits)).drop("__a", "__b", "__l"))


def embedding_score(pairs: DataFrame, left: str, right: str, digits: int = 4) -> DataFrame:
    """Mean, min and max cosine of paired vectors."""
    from .nearest import cosine
    s = pairs.select(cosine(left, right).alias("s"))
    return s.agg(F.round(F.avg("s"), digits).alias("f1_mean"), F.round(F.min("s"), digits).alias("f1_min"),
                 F.round(F.max("s"), digits).alias("f1_max"))


# --- answers ---------------------------------------------------------------------


def folded(c) -> Column:
    return F.trim(F.regexp_replace(T.normalize(c), r"\s+", " "))


def content_ok(answer, must_all: Column, must_any: Column) -> Column:
    """All of the first list and any of the second occur; NULL when both are empty."""
    a = folded(answer)
    empty = F.array().cast("array<string>")
    must_all, must_any = F.coalesce(must_all, empty), F.coalesce(must_any, empty)
    ok = F.forall(must_all, lambda t: F.contains(a, folded(t)))
    any_ok = (F.size(must_any) == 0) | F.exists(must_any, lambda t: F.contains(a, folded(t)))
    return F.when((F.size(must_all) > 0) | (F.size(must_any) > 0), ok & any_ok)


def tools_ok(used: Column, expected: Column) -> Column:
    """Any expected tool was used; NULL when none is expected."""
    return F.when(F.size(F.coalesce(expected, F.array().cast("array<string>"))) > 0,
                  F.coalesce(F.arrays_overlap(used, expected), F.lit(False)))


JUDGE_FIELDS = ("fidelidade", "relevancia", "completude")


def judge(reply) -> Column:
    """Grades of a judge's reply: its JSON object, else digits rescued by pattern.

    Grades are cut to 0..10; a missing or unusable grade is NULL.
    """
    r = T._col(reply)
    body = F.regexp_extract(r, r"(\{[^{}]*\})", 1)
    parsed = F.from_json(F.when(body != "", body), ", ".join(f"{f} STRING" for f in JUDGE_FIELDS) + ", justificativa STRING")

    def grade(name: str) -> Column:
        rescued = F.nullif(F.regexp_extract(r, rf'"{name}"\s*:\s*(\d+)', 1), F.lit(""))
        raw = F.when(body != "", parsed[name]).otherwise(rescued).try_cast("double").cast("int")
        return F.greatest(F.lit(0), F.least(F.lit(10), raw))

    def bounded(name: str) -> Column:
        g = grade(name)
        known = F.when(body != "", parsed[name]).otherwise(
            F.nullif(F.regexp_extract(r, rf'"{name}"\s*:\s*(\d+)', 1), F.lit(""))).try_cast("double").isNotNull()
        return F.when(known, g).alias(name)

    why = F.when(body != "", parsed["justificativa"]).otherwise(
        F.nullif(F.regexp_extract(r, r'"justificativa"\s*:\s*"([^"]*)', 1), F.lit("")))
    return F.struct(*[bounded(f) for f in JUDGE_FIELDS], why.alias("justificativa"))


def batch_report(results: DataFrame, digits: int = 4) -> DataFrame:
    """One row of totals over evaluated answers.

    results: content_ok, tool_ok (nullable booleans), rouge_f1, cos_emb, seconds.
    """
    def share(c: str) -> Column:
        return F.round(F.avg(F.when(F.col(c).isNotNull(), F.col(c).cast("int"))), digits).alias(c)

    return results.agg(F.count("*").alias("items"), share("content_ok"), share("tool_ok"),
                       *[F.round(F.avg(c), digits).alias(c) for c in ("rouge_f1", "cos_emb", "seconds")])
