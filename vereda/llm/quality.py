"""A quality classifier from positives and unlabelled text: non-negative positive-unlabelled learning.

Trusted positives are the labelled good documents; all learning rows, whatever their label, stand for unlabelled web text. A linear model
over language-independent features (frequencies of character class trigrams, repetition) minimises the non-negative
unbiased risk  pi R_p+ + max(0, R_u- - pi R_p-)  under the logistic loss: where the estimated negative risk falls below
zero the step is reversed, as the estimator then overfits. The class prior pi is itself estimated: a first classifier
of positives against unlabelled text ranks both; the least ratio of the shares above a threshold, with a confidence
margin, bounds the share of positives among the unlabelled (best bin estimation).

The model is fitted on a bounded sample (FIT_POSITIVES and FIT_UNLABELLED rows, those of least hash); every text is scored whole.

Edge cases: a NULL text scores like the empty one. Without positives or unlabelled rows every score is 0.5. Labels that
are NULL or belong to no document are not used; a document with both labels is no positive. NULL ids are scored and not held out, repeated
rows are separate rows, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the fitting sample.
FIT_POSITIVES, FIT_UNLABELLED = 3_000, 6_000
THRESHOLD = 0.3
#: Character classes: lower, upper, digit, space, line end, comma, full stop, other sentence marks, symbols, other bytes.
_CLASSES = 10
_SLICE = 1 << 20


def _class_table() -> bytes:
    table = bytearray([9] * 256)
    for code in range(128):
        c = chr(code)
        table[code] = (0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c in "\n\r" else 3 if c.isspace() or code < 32
                       else 5 if c == "," else 6 if c == "." else 7 if c in "!?;:" else 8)
    return bytes(table)


_TABLE = _class_table()
N_FEATURES = _CLASSES ** 3 + 6


def features(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    grams = np.zeros(_CLASSES ** 3, np.int64)
    for at in range(0, len(data), _SLICE):
        c = np.frombuffer(data[at:at + _SLICE + 2].translate(_TABLE), np.uint8).astype(np.int32)
        if len(c) > 2:
            grams += np.bincount(c[:-2] * _CLASSES ** 2 + c[1:-1] * _CLASSES + c[2:], minlength=len(grams))
    words = data.split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if x]
    tail = [n and len(set(words)) / n, n and sum(map(bytes.__eq__, words, words[1:])) / n, n and sum(map(len, words)) / n / 10,
            np.log1p(n) / 10, len(set(lines)) / len(lines) if lines else 0.0, float(n == 0)]
    return np.concatenate([np.sqrt(grams / max(1, grams.sum())), tail]).astype(np.float32)


class Model:
    """Weights over standardised features, and the class prior they were fitted under."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3):
        self.prior = 0.5
        self.weights, self.bias = np.zeros(N_FEATURES, np.float32), 0.0
        if not len(positive) or not len(unlabelled):
            return
        both = np.concatenate([positive, unlabelled])
        mean, scale = both.mean(0), np.maximum(both.std(0), 0.01)
        p, u = (positive - mean) / scale, (unlabelled - mean) / scale
        ranking, bias = _descend(p, u, None, seed)
        self.prior = _prior(p @ ranking + bias, u @ ranking + bias)
        weights, bias = _descend(p, u, self.prior, seed)
        self.weights = (weights / scale).astype(np.float32)
        self.bias = float(bias - (mean / scale) @ weights)

    def score(self, text: str | None) -> float:
        z = float(features(text) @ self.weights) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None, seed: int, steps: int = 600, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Adam on mini-batches. prior None: plain logistic regression of p against u, else the non-negative risk."""
    rng = np.random.default_rng(seed)
    w = np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        a, b = p[rng.integers(0, len(p), 256)], u[rng.integers(0, len(u), 512)]
        za, zb = a @ w[:-1] + w[-1], b @ w[:-1] + w[-1]
        ga, gb = _sigmoid(za), _sigmoid(zb)
        up = -(1 - ga) / len(a)  # slope of the loss of positives taken as positive
        down_p, down_u = ga / len(a), gb / len(b)  # and of either taken as negative
        if prior is None:
            slope_a, slope_b = up, down_u
        else:
            negative = np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean()
            if negative >= 0:
                slope_a, slope_b = prior * up - prior * down_p, down_u
            else:
                slope_a, slope_b = prior * down_p, -down_u
        grad = np.append(slope_a @ a + slope_b @ b + penalty * w[:-1], slope_a.sum() + slope_b.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w -= 0.02 / (1 + 3 * step / steps) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def _prior(zp: np.ndarray, zu: np.ndarray) -> float:
    """Best bin: the least share of unlabelled over share of positives above a threshold, with a confidence margin."""
    cuts = np.quantile(zp, np.linspace(0, 0.9, 181))
    sp = 1 - np.searchsorted(np.sort(zp), cuts) / len(zp)
    su = 1 - np.searchsorted(np.sort(zu), cuts) / len(zu)
    margin = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(len(zu)) + 1 / np.sqrt(len(zp)))
    best = np.argmin((su + margin) / np.maximum(sp, 1e-9))
    return float(np.clip(su[best] / max(sp[best], 1e-9), 0.05, 0.98))


def held_out(docs: DataFrame) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, positives: int = FIT_POSITIVES, unlabelled: int = FIT_UNLABELLED) -> Model:
    """The model from a bounded sample of learning rows: those with an id that are not held out."""
    ids = docs.filter(F.col("doc_id").isNotNull() & ~held_out(docs)).select("doc_id")
    told = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(labels)).groupBy("doc_id")
    told = told.agg(F.min("quality").alias("least"))
    order = F.xxhash64("doc_id", F.lit("fit"))
    good = told.filter("least = 1").select("doc_id", F.lit(1).alias("good")).orderBy(order, "doc_id").limit(positives)
    other = ids.distinct().select("doc_id", F.lit(0).alias("good")).orderBy(order, "doc_id").limit(unlabelled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"good": b["good"], "x": [features(t if isinstance(t, str) else None).tobytes() for t in b["text"]]})

    # The ids of the sample: at most FIT_POSITIVES + FIT_UNLABELLED, so broadcasting them is bounded.
    sample = docs.select("doc_id", "text").join(F.broadcast(good.union(other)), "doc_id").select("good", "text")
    rows = sample.mapInPandas(run, "good int, x binary").toPandas()
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, N_FEATURES) if len(rows) else np.empty((0, N_FEATURES), np.float32)
    good_rows = rows["good"].to_numpy() == 1 if len(rows) else np.empty(0, bool)
    return Model(x[good_rows], x[~good_rows])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with a score from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t if isinstance(t, str) else None) for t in texts], dtype="float64")

    return docs.withColumn("score", F.pandas_udf(run, "double")(F.col(text)))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of query op7_quality."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(docs).alias("held_out"), "text")
    scored = score(rows, learn(docs, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
