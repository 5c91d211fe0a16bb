"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For each bit a binary classifier over hashed byte n-grams tells the languages
with +1 from those with -1; its margin is the mean log odds of the text's n-grams, scaled with the amount of evidence.
Loss-weighted decoding takes the language whose codeword has the least logistic loss over all bits; the runner-up being
close flags the text as ambiguous. The classifiers are counts of n-grams per language, summed in Spark over all learning
rows, so nothing is sampled; the table has languages x buckets entries and is bounded by these two parameters.

Edge cases: texts that are NULL or have no letter are `und` with score 0, as is every text if nothing could be learned.
Learning rows without a language, id or letter are not used. Texts of any length are read whole, in slices. Rows are
independent: repeated ids give repeated rows, NULL ids are kept with held_out false, other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Buckets for n-grams of one, two and three bytes.
BUCKETS = (256, 1 << 12, 1 << 14)
#: Most languages that may be learned: with the buckets it bounds what the driver holds.
MOST_LANGUAGES = 512
#: A runner-up whose probability is at least this share of the winner's makes a text ambiguous.
AMBIGUOUS = 0.5
_SLICE = 1 << 18


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords (rows) of +1 and -1: all distinct splits for up to five languages, else random ones far apart."""
    if n == 0:
        return np.ones((0, 1), np.int8)
    if n <= 5:
        rest = list(itertools.product((1, -1), repeat=max(n - 1, 0)))
        splits = [(1, *x) for x in rest if -1 in x]
        return np.array(splits or [(1,) * n], dtype=np.int8).T.reshape(n, -1)
    width, rng, best, apart = 10 * math.ceil(math.log2(n)) + 5, np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice(np.array([1, -1], np.int8), (n, width))
        code = code[:, np.abs(code.sum(0)) < n]
        gram = code.astype(np.int32) @ code.T.astype(np.int32)
        least = int(((code.shape[1] - gram) // 2 + np.eye(n, dtype=int) * code.shape[1]).min())
        if least > apart:
            best, apart = code, least
    return best


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams, slice by slice."""
    data = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(data), _SLICE):
        a = data[at:at + _SLICE + 2].astype(np.uint32)
        n = min(len(data) - at, _SLICE)
        pair = (a[:-1] * np.uint32(256) + a[1:])[:n]
        triple = (a[:-2] * np.uint32(65536) + a[1:-1] * np.uint32(256) + a[2:])[:n]
        yield np.concatenate([
            a[:n],
            ((pair * np.uint32(2654435761)) >> np.uint32(20)) + np.uint32(BUCKETS[0]),
            ((triple * np.uint32(2246822519)) >> np.uint32(18)) + np.uint32(BUCKETS[0] + BUCKETS[1])])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n: n-gram counts of the texts per language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                if isinstance(text, str) and has_letter(text):
                    mine = held.setdefault(lang, np.zeros(sum(BUCKETS), np.int64))
                    for part in grams(text):
                        mine += np.bincount(part, minlength=len(mine))
            if len(held) > 64:
                yield from map(rows, held.items())
                held = {}
        yield from map(rows, held.items())

    def rows(item: tuple[str, np.ndarray]) -> pd.DataFrame:
        at = np.flatnonzero(item[1])
        return pd.DataFrame({"lang": item[0], "bucket": at, "n": item[1][at]})

    found = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    return found.mapInPandas(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages, their codewords, and per bucket the log odds of each bit."""

    def __init__(self, table: pd.DataFrame):
        self.langs = sorted(table["lang"].unique())
        if len(self.langs) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        place = {lang: i for i, lang in enumerate(self.langs)}
        n = np.zeros((len(self.langs), sum(BUCKETS)))
        n[table["lang"].map(place).to_numpy(int), table["bucket"].to_numpy(int)] = table["n"]
        self.code = codewords(len(self.langs))
        share = np.empty_like(n)
        for a, b in itertools.pairwise(np.cumsum((0, *BUCKETS))):
            share[:, a:b] = (n[:, a:b] + 0.05) / (n[:, a:b].sum(1, keepdims=True) + 0.05 * (b - a))
        # The languages of a side count alike, however many rows they have.
        sides = [((self.code == s).T @ share) / np.maximum((self.code == s).sum(0), 1)[:, None] for s in (1, -1)]
        self.odds = np.ascontiguousarray(np.log(np.maximum(sides[0], 1e-300) / np.maximum(sides[1], 1e-300)).T, np.float32)

    def losses(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.odds.shape[1]), 0
        for part in grams(text):
            total += self.odds[part].sum(0, dtype=np.float64)
            n += len(part)
        margin = total / n * min(math.sqrt(n / 3.0), 12.0)
        return np.logaddexp(0.0, -self.code * margin).sum(1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, False
        loss = self.losses(text)
        p = np.exp(-(loss - loss.min()))
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        close = len(order) > 1 and p[order[1]] >= AMBIGUOUS * p[order[0]]
        return self.langs[order[0]], float(p[order[0]]), bool(close)


def fit(docs: DataFrame) -> Model:
    return Model(counts(docs).toPandas())


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.predict(t if isinstance(t, str) else None) for t in texts]
        return pd.DataFrame(found, columns=["lang_pred", "score", "ambiguous"])

    kind = "lang_pred string, score double, ambiguous boolean"
    told = docs.withColumn("_langid", F.pandas_udf(run, kind)(F.col(text)))
    drop = [c for c in ("lang_pred", "score", "ambiguous") if c in docs.columns]
    return told.drop(*drop).select("*", "_langid.*").drop("_langid")


def held_out(docs: DataFrame) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> Model:
    """The model of all learning rows: those with an id that are not held out."""
    return fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out(docs)))


def digest(docs: DataFrame) -> DataFrame:
    """The result of query op1_langid."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(docs).alias("held_out"), "text")
    return predict(rows, learn(docs)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that have a language: those without a letter go. If nothing could be learned, the others stay."""
    model, rows = learn(docs), docs.select(F.struct(*docs.columns).alias("_row"), "text")
    if model.langs:
        return predict(rows, model).filter(F.col("lang_pred") != UNKNOWN).select("_row.*")

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([isinstance(t, str) and has_letter(t) for t in texts], dtype=bool)

    return rows.filter(F.pandas_udf(run, "boolean")(F.col("text"))).select("_row.*")
