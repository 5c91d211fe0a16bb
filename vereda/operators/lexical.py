"""BM25 ranking of a text column.

Two aggregations gather the corpus statistics (both with map-side partials);
scoring is one pass over the documents that keeps k rows per question in each
task, so common words never produce a document-by-question pair list.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import text as T
from . import nearest

# Okapi parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25
DIGITS = 6
# Products of a document's term and a question's that a task holds at a time; common words meet every question.
HELD_PRODUCTS = 1 << 20


@dataclass(frozen=True)
class Stats:
    """Corpus statistics; `floor` replaces every negative idf."""

    n_docs: int
    avg_len: float
    floor: float


def statistics(docs: DataFrame, text: str = "text", tokenizer=T.words) -> tuple[Stats, DataFrame]:
    """Corpus statistics and the (term, n) document-frequency table.

    One pass: each document also counts under the empty term, which carries its
    length, so the table holds the corpus totals too. It is stored because the
    statistics and the question weights both read it.
    """
    toks = docs.select(tokenizer(F.col(text)).alias("toks"))
    rows = toks.select(F.explode(F.array_append(F.array_distinct("toks"), F.lit(""))).alias("term"), F.size("toks").alias("len"))
    table = session.checkpoint(rows.groupBy("term").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("term") == "", F.col("len"))).alias("len")))
    total = table.filter(F.col("term") == "").first()
    n = total["n"] if total else 0
    df = table.filter(F.col("term") != "").select("term", "n")
    mean = df.agg(F.avg(F.log(F.lit(n) - F.col("n") + 0.5) - F.log(F.col("n") + 0.5))).first()[0]
    return Stats(n, (total["len"] or 0) / n if n else 0.0, EPSILON * (mean or 0.0)), df


def search(docs: DataFrame, questions: DataFrame, k: int, *, text: str = "text",
           tokenizer=T.words, digits: int = DIGITS, bound: int = nearest.BROADCAST_QUESTIONS) -> DataFrame:
    """Top k documents per question; repeated question words count again.

    docs: id, text; questions: query_id, text. Every document is ranked, also
    those with score 0, and ties go to the smaller id.
    """
    scored = _scored(docs, questions, k, text, tokenizer, digits, bound)
    return nearest.top(scored, k, ascending=False)


def _scored(docs, questions, k, text, tokenizer, digits, bound):
    stats, df = statistics(docs, text, tokenizer)
    weighted = weigh(questions, df, stats, text, tokenizer)
    # Tokens hold no blank: one string per text crosses to Python, not a list.
    payload = docs.select("id", F.array_join(tokenizer(F.col(text)), " ").alias("toks"))

    def prepare(q: pd.DataFrame):
        return term_matrix(q["terms"])

    def score(payload: pd.Series, block) -> np.ndarray:
        return score_tokens([x.split(" ") if x else [] for x in payload], block, stats)

    return nearest.run_scored(payload, "toks", weighted, prepare, score, k=k, ascending=False,
                              digits=digits, bound=bound)


def term_matrix(term_lists) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray, int]:
    """Vocabulary and, as compressed rows per term, the questions using it and their weights."""
    vocab: dict[str, int] = {}
    found = [(vocab.setdefault(t["term"], len(vocab)), j, t["w"])
             for j, terms in enumerate(term_lists) if terms is not None for t in terms]
    found.sort(key=lambda x: x[:2])
    at = np.array([x[0] for x in found], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(vocab)))]).astype(np.int64)
    return vocab, starts, np.array([x[1] for x in found], dtype=np.int64), np.array([x[2] for x in found]), len(term_lists)


def score_tokens(token_lists, block, stats: Stats) -> np.ndarray:
    """BM25 of each token list for each question of the block: a sparse product of term counts and weights."""
    vocab, starts, cols, vals, n_questions = block
    sizes = np.array([len(x) for x in token_lists], dtype=np.int64)
    known = vocab.get
    flat = np.fromiter((known(t, -1) for toks in token_lists for t in toks), np.int64, sizes.sum())
    row = np.repeat(np.arange(len(sizes)), sizes)[flat >= 0]
    if not len(row):
        return np.zeros((len(sizes), n_questions))
    pairs, f = np.unique(row * len(vocab) + flat[flat >= 0], return_counts=True)
    row, term = pairs // len(vocab), pairs % len(vocab)
    norm = K1 * (1 - B + B * sizes / stats.avg_len) if stats.avg_len else np.full(len(sizes), K1)
    gain = f * (K1 + 1) / (f + norm[row])
    # Each (document, term) meets the questions of its term, for as many documents at a time as the bound lets.
    many = starts[term + 1] - starts[term]
    first = np.searchsorted(row, np.arange(len(sizes) + 1))
    before = np.concatenate([[0], np.cumsum(many)])[first]
    out, start = np.empty((len(sizes), n_questions)), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(before, before[start] + HELD_PRODUCTS, "right")) - 1)
        part = slice(first[start], first[stop])
        m = many[part]
        at = np.repeat(starts[term[part]] - np.cumsum(m) + m, m) + np.arange(m.sum())
        cell = np.repeat(row[part] - start, m) * n_questions + cols[at]
        out[start:stop] = np.bincount(cell, np.repeat(gain[part], m) * vals[at], (stop - start) * n_questions).reshape(-1, n_questions)
        start = stop
    return out


def weigh(questions: DataFrame, df: DataFrame, stats: Stats, text: str, tokenizer) -> DataFrame:
    """query_id with its (term, idf x multiplicity) list.

    Done as a join with the frequency table, so neither side visits the driver.
    """
    qt = (questions.select("query_id", F.explode(tokenizer(F.col(text))).alias("term"))
          .groupBy("query_id", "term").agg(F.count("*").alias("m")))
    raw = F.log(F.lit(stats.n_docs) - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)
    weight = F.when(raw < 0, F.lit(stats.floor)).otherwise(raw) * F.col("m")
    found = (qt.join(df, "term").select("query_id", F.struct("term", weight.alias("w")).alias("t"))
             .groupBy("query_id").agg(F.collect_list("t").alias("terms")))
    return questions.select("query_id").join(found, "query_id", "left")


def overlap(question, document):
    """Share of the question's distinct tokens that occur in the document."""
    q, d = F.array_distinct(T.tokens(question)), F.array_distinct(T.tokens(document))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, d)) / F.size(q))
