"""Response cache and result paging over request logs.

A request is (key text, second). An exact entry lives `ttl` seconds from the
miss that created it; hits do not extend it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import setjoin

# Fixed values.
TTL, MAX_ENTRIES, FUZZY = 3600, 512, 0.82
PAGE, FETCH, SESSION_TTL, MAX_SESSIONS = 4, 40, 1800, 256


def keyed(requests: DataFrame, text: str) -> DataFrame:
    """Add the normal form of the question and its hash."""
    q = T.question_key(F.col(text))
    return requests.withColumn("question", q).withColumn("key", F.sha2(q, 256))


def exact_entries(requests: DataFrame, ttl: int = TTL) -> DataFrame:
    """Entries of an exact cache: key, created, hits (the creating miss excluded).

    Requests of a key within one second are counted together first, so a key's
    scan is bounded by the length of the log in seconds however hot it is. The
    scan itself streams over sorted partitions with constant memory.
    """
    per = requests.groupBy("key", "sec").agg(F.count("*").alias("n"))
    ordered = per.repartition("key").sortWithinPartitions("key", "sec")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, created, hits = None, None, 0
        for pdf in batches:
            out = []
            for k, s, n in zip(pdf["key"], pdf["sec"], pdf["n"]):
                if k == key and s - created <= ttl:
                    hits += n
                    continue
                if key is not None:
                    out.append((key, created, hits))
                key, created, hits = k, s, n - 1
            if out:
                yield pd.DataFrame(out, columns=["key", "created", "hits"])
        if key is not None:
            yield pd.DataFrame([(key, created, hits)], columns=["key", "created", "hits"])

    return ordered.mapInPandas(scan, "key string, created long, hits long")


def stats(entries: DataFrame) -> DataFrame:
    """Entries created, hits, misses and hit rate."""
    return entries.agg(
        F.countDistinct("key").alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"),
        F.count("*").alias("misses")).withColumn(
        "hit_rate", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 6))


def lookup_exact(requests: DataFrame, entries: DataFrame, ttl: int = TTL) -> DataFrame:
    """Requests answered by an unexpired entry of the same key."""
    e = entries.select("key", F.col("created").alias("c"))
    age = F.col("sec") - F.col("c")
    return (requests.join(e, "key").filter((age >= 0) & (age <= ttl))
            .groupBy(*requests.columns).agg(F.max("c").alias("created")))


def lookup_fuzzy(requests: DataFrame, entries: DataFrame, threshold: float = FUZZY, ttl: int = TTL) -> DataFrame:
    """First unexpired entry, in insertion order, similar to each request.

    requests: id, question, sec. entries: question, created. An entry can only
    serve requests of its own or the next time slice of length `ttl`, so texts
    are compared inside slices, each distinct text once per slice.
    """
    def slice_of(c: str) -> Column:
        return F.floor(F.col(c) / ttl)

    served = F.explode(F.array(slice_of("sec"), slice_of("sec") - 1)).alias("block")
    pairs = setjoin.jaccard_join(requests.select(served, F.col("question").alias("text")),
                                 entries.select(slice_of("created").alias("block"), F.col("question").alias("text")),
                                 threshold, blocked=True, of=T.string_trigrams)
    # Pairs of distinct texts first: copies of a question fan out only here, and only within their slice.
    req = requests.select(setjoin.text_id("question").alias("left_id"), "id", "sec", served)
    ent = entries.select(setjoin.text_id("question").alias("right_id"), "question", "created", slice_of("created").alias("block"))
    age = F.col("sec") - F.col("created")
    return (pairs.join(setjoin.shuffled(req), ["left_id", "block"]).join(setjoin.shuffled(ent), ["right_id", "block"]).filter((age >= 0) & (age <= ttl))
            .groupBy("id").agg(F.min(F.struct("created", "question", "sim")).alias("m"))
            .select("id", F.col("m.created").alias("created"), F.col("m.question").alias("entry"),
                    F.col("m.sim").alias("sim")))


def evict(entries: DataFrame, now: int, ttl: int = TTL, limit: int = MAX_ENTRIES) -> DataFrame:
    """Survivors: unexpired, then the newest `limit`."""
    alive = entries.filter(F.lit(now) - F.col("created") <= ttl)
    return alive.orderBy(F.col("created").desc(), F.col("key").asc()).limit(limit)


def pages(results: DataFrame, size: int = PAGE, fetch: int = FETCH) -> DataFrame:
    """Page number and number of results left after each row.

    results: query_id, rank (at most `fetch` rows per question are kept).
    """
    kept = results.filter(F.col("rank") <= fetch)
    n = kept.groupBy("query_id").agg(F.count("*").alias("n"))
    page = F.floor((F.col("rank") - 1) / size).cast("long")
    return (kept.join(n, "query_id").withColumn("page", page)
            .withColumn("remaining", F.greatest(F.lit(0), F.col("n") - (F.col("page") + 1) * size)).drop("n"))


def live_sessions(sessions: DataFrame, now: int, ttl: int = SESSION_TTL, limit: int = MAX_SESSIONS) -> DataFrame:
    """Paging sessions kept when a new one arrives: unexpired, newest limit - 1."""
    alive = sessions.filter(F.lit(now) - F.col("created") <= ttl)
    return alive.orderBy(F.col("created").desc(), F.col("session_id").asc()).limit(limit - 1)


def cacheable(route: Column, pending: Column) -> Column:
    """An answer is stored unless a list is pending or a shortcut produced it."""
    return ~pending & (route == "search")

