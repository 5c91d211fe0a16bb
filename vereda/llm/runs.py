"""Periodic runs of words: an enhanced suffix array tested for branching tandem repeats.

A run is a stretch of words with smallest period q, at least two periods long, that no neighbouring word continues. The
last square of a run is branching: its two halves' suffixes agree on exactly q words. So all runs show as pairs of suffixes
i and i + q that part at depth q of the suffix order:

* the suffixes of a batch of documents are ordered by prefix doubling, each document on its own, and the lengths of common
  prefixes are read off the ranks of the rounds;
* each common-prefix length bounds an interval of the order, split at it in two; no tree is built. For every suffix i of
  the smaller part, ISA[i + depth] and ISA[i - depth] are looked up in the other part, which takes O(n log n) look-ups;
* squares are rotated to the left as far as the period goes on. Squares of one end whose period is a multiple of a found
  run's are inside it and are dropped unrotated, so a text of one word repeated costs no more than others.

A document is one unit of work; batches hold whole documents. Look-ups are made in slices, so memory follows the words of
the longest document (about 200 bytes a word).

Edge cases: NULL, empty and blank texts have no words and no runs. Rows are independent, so repeated rows give repeated
rows; a NULL id is returned. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, exact_ids

#: Least words of a run that is reported.
LEAST = 12
#: Words of a batch of documents and look-ups of a slice (memory only).
BATCH_WORDS, SLICE = 100_000, 1 << 19

Run = tuple[int, int, int]


def suffix_order(token: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order, the place of each, and the common prefix of each with the one before it.

    token: words as small non-negative numbers, documents one after the other; end: for each word, where its document ends.
    Documents are ordered one after the other too, and a suffix ends with its document.
    """
    n = len(token)
    key = end * (int(token.max(initial=0)) + 1) + token
    order = np.argsort(key, kind="stable")
    head = np.r_[True, key[order[1:]] != key[order[:-1]]][:n]
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels, depth = [rank.astype(np.int32)], 1
    while True:
        tied = ~head | np.r_[~head[1:], np.zeros(min(n, 1), bool)]
        spots = np.flatnonzero(tied)
        if not len(spots):
            break
        at = order[spots]
        far = at + depth
        inside = far < end[at]
        key = rank[at] * (n + 1) + np.where(inside, rank[np.minimum(far, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[spots] = at
        new = np.r_[True, key[1:] != key[:-1]]
        head[spots] = new
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new, spots, 0))
        levels.append(rank.astype(np.int32))
        depth *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    common = np.zeros(n, np.int64)
    first = levels[0]
    k = np.flatnonzero(np.r_[np.zeros(min(n, 1), bool), first[order[1:]] == first[order[:-1]]])
    p, q, got = order[k - 1].copy(), order[k].copy(), np.zeros(len(k), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks = levels[level]
        same = (p < end[order[k - 1]]) & (q < end[order[k]])
        same[same] = ranks[p[same]] == ranks[q[same]]
        step = same * (1 << level)
        p, q, got = p + step, q + step, got + step
    common[k] = got
    return order, place, common


def _bounds(common: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of `at`: the nearest earlier place with no larger, the nearest later one with a smaller common prefix."""
    n = len(common)
    size = np.r_[common, 0]
    found = []
    for step, stop in ((-1, np.less_equal), (1, np.less)):
        to = np.arange(n + 1) + step
        open_ = at
        for _ in range(48):
            open_ = open_[~stop(size[to[open_]], size[open_])]
            if not len(open_):
                break
            to[open_] = to[to[open_]]
        else:
            # Long stairs are walked hop by hop; each place's bound is known before it is needed.
            stack: list[int] = []
            values = size.tolist()
            for k in (range(n + 1) if step < 0 else range(n, -1, -1)):
                while stack and (values[stack[-1]] > values[k] if step < 0 else values[stack[-1]] >= values[k]):
                    stack.pop()
                to[k] = stack[-1] if stack else (0 if step < 0 else n)
                stack.append(k)
        found.append(to[at])
    return found[0], found[1]


def branching_squares(order: np.ndarray, place: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square whose halves' suffixes part exactly at the period."""
    n = len(order)
    at = np.flatnonzero(common)
    low, high = _bounds(common, at)
    left = at - low <= high - at
    begin, size = np.where(left, low, at), np.where(left, at - low, high - at)
    other_low, other_high, depth = np.where(left, at, low), np.where(left, high, at), common[at]
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    total = np.cumsum(size)
    cut = 0
    while cut < len(at):
        upto = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + SLICE, "right")))
        s = slice(cut, upto)
        of = np.repeat(np.arange(cut, upto), size[s])
        within = np.arange(len(of)) - np.repeat(np.cumsum(size[s]) - size[s], size[s])
        p, d, lo, hi = order[begin[of] + within], depth[of], other_low[of], other_high[of]
        for far, start in ((p + d, p), (p - d, p - d)):
            inside = (far >= 0) & (far < n)
            where = place[np.where(inside, far, 0)]
            hit = inside & (where >= lo) & (where < hi)
            starts.append(start[hit])
            periods.append(d[hit])
        cut = upto
    return np.concatenate(starts), np.concatenate(periods)


def _rotated(token: np.ndarray, start: np.ndarray, period: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Each start moved left while the period goes on, not below its document's first word (floor)."""
    start = start.copy()
    open_ = np.arange(len(start))
    for _ in range(24):
        s = start[open_]
        more = s > floor[open_]
        more[more] = token[s[more] - 1] == token[s[more] - 1 + period[open_][more]]
        open_ = open_[more]
        if not len(open_):
            return start
        start[open_] -= 1
    for k in open_:
        s, q, low, step = int(start[k]), int(period[k]), int(floor[k]), 64
        while s > low:
            a = max(low, s - step)
            unlike = np.flatnonzero(token[a:s] != token[a + q:s + q])
            if len(unlike):
                s = a + int(unlike[-1]) + 1
                break
            s, step = a, step * 2
        start[k] = s
    return start


def find_runs(token: np.ndarray, first: np.ndarray, end: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least `least` words, in words of the whole array.

    first, end: for each word, where its document begins and ends.
    """
    if not len(token):
        return np.zeros((0, 3), np.int64)
    start, period = branching_squares(*suffix_order(token, end))
    stop = start + 2 * period
    by = np.lexsort((period, stop))
    start, period, stop = start[by], period[by], stop[by]
    found = [np.zeros((0, 3), np.int64)]
    while len(start):
        lead = np.r_[True, stop[1:] != stop[:-1]]
        s, q, e = _rotated(token, start[lead], period[lead], first[start[lead]]), period[lead], stop[lead]
        found.append(np.stack([s, e - s, q], axis=1))
        group = np.cumsum(lead) - 1
        inside = (period % q[group] == 0) & (start >= s[group])
        start, period, stop = start[~inside], period[~inside], stop[~inside]
    runs = np.concatenate(found)
    runs = runs[runs[:, 1] >= np.maximum(least, 2 * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _documents(batches: Iterator[pd.DataFrame], change: Callable | None, least: int) -> Iterator[list[tuple]]:
    """Lists of (id, words, runs of the document, which words are kept), a batch of documents at a time."""
    held: list[tuple] = []
    size = 0

    def solved() -> list[tuple]:
        lengths = np.array([len(w) for _, w in held], np.int64)
        ends = np.cumsum(lengths)
        names: dict[bytes, int] = {}
        for _, w in held:
            names.update(dict.fromkeys(w))
        names = {w: i for i, w in enumerate(names)}
        token = np.fromiter((names[w] for _, words in held for w in words), np.int64, int(ends[-1]))
        first, end = np.repeat(ends - lengths, lengths), np.repeat(ends, lengths)
        runs = find_runs(token, first, end, least)
        cover = np.zeros(len(token) + 1, np.int64)
        np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
        np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(cover)[:-1] == 0
        cuts = np.searchsorted(runs[:, 0], np.r_[0, ends])
        out = []
        for k, (doc_id, words) in enumerate(held):
            begin = int(ends[k] - lengths[k])
            own = runs[cuts[k]:cuts[k + 1]] - [begin, 0, 0]
            out.append((doc_id, words, own, kept[begin:int(ends[k])]))
        return out

    for b in batches:
        for doc_id, text in zip(b["doc_id"], b["text"]):
            words = WORD_BYTES.findall(text.encode("utf-8", "surrogatepass")) if isinstance(text, str) else []
            if change is not None:
                words = change(doc_id, words)
            held.append((doc_id, words))
            size += len(words)
            if size >= BATCH_WORDS or len(held) >= 5000:
                yield solved()
                held, size = [], 0
    if held:
        yield solved()


def _joined(words: list[bytes], kept: np.ndarray) -> bytes:
    return b" ".join(words if kept.all() else [words[i] for i in np.flatnonzero(kept)])


def collapsed(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length, period by start and period), text: the words outside repetitions, joined by one space.

    Of each run the first period stays. A document without a run keeps its words.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _documents(batches, None, least):
            yield pd.DataFrame({
                "doc_id": [x[0] for x in part],
                "runs": [[dict(zip(("start", "length", "period"), r)) for r in x[2].tolist()] for x in part],
                "text": [_joined(x[1], x[3]).decode("utf-8", "surrogatepass") for x in part]})

    made = exact_ids(docs, "text").mapInPandas(run, "doc_id string, runs array<struct<start: long, length: long, period: long>>, text string")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def planted(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """The query's periodic tails: with h = crc32 of the id in decimal, one document in ten repeats words from a place on."""
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a:a + p]
    return words[:a] + (block * (-(-(n - a) // len(block))))[:n - a]


def digest(docs: DataFrame) -> DataFrame:
    """The result of query op12_runs."""
    columns = "doc_id string, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _documents(batches, planted, LEAST):
            rows = []
            for doc_id, words, runs, kept in part:
                best = (None,) * 4
                if len(runs):
                    start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
                    best = (start, length, period, 1000 * length // period)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
                rows.append((doc_id, len(runs), *best, sha(listed.encode()), sha(_joined(words, kept))))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])
            for name in ("start", "length", "period", "exponent_milli"):
                out[name] = pd.array(out[name].tolist(), dtype="Int64")
            yield out

    return exact_ids(docs, "text").mapInPandas(run, columns).withColumn("doc_id", F.col("doc_id").cast("long"))
