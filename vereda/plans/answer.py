"""Batch form of the question-answering cascade.

A batch of questions flows through stages ordered by cost; each stage fills
`route` for the rows it settles and only unresolved rows reach retrieval.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import fusion, respcache, setjoin

# Fixed values.
FETCH, FINAL, RETRIEVE = 40, 4, 10
TITLE_SHORTCUT, TITLE_ENRICH = 0.35, 0.45


def plan(asked: DataFrame, pending: DataFrame | None = None, entries: DataFrame | None = None, *,
         guard: bool = True) -> DataFrame:
    """Route of each question: query_id, route, collection, detail.

    asked: query_id, session_id, sec, text. pending: session_id with an open
    result list. entries: cached questions (key, created).
    """
    q = respcache.keyed(asked, "text")
    if pending is not None:
        q = q.join(pending.select("session_id").distinct().withColumn("has_list", F.lit(True)), "session_id", "left")
    else:
        q = q.withColumn("has_list", F.lit(None).cast("boolean"))
    if entries is not None:
        hit = respcache.lookup_exact(q.select("query_id", "key", "sec"), entries).select("query_id", F.lit(True).alias("cached"))
        q = q.join(hit, "query_id", "left")
    else:
        q = q.withColumn("cached", F.lit(None).cast("boolean"))
    q = q.withColumn("g", R.guard_input("text")).withColumn("i", R.intent("text"))
    g, intent = F.col("g"), F.col("i")
    blocked = ~g["passed"] if guard else F.lit(False)
    route = (F.when(F.coalesce("has_list", F.lit(False)) & R.is_continuation("text"), "continuation")
             .when(F.coalesce("cached", F.lit(False)), "cache")
             .when(blocked, "blocked")
             .when(R.is_area_question("text"), "area")
             .when(intent.isNotNull(), "structured")
             .when(R.type_hint("text").isNotNull() & R.entity_candidate("text").isNotNull(), "entity")
             .when(R.route("text").isNotNull(), "search").otherwise("search_all"))
    detail = (F.when(F.col("route") == "blocked", g["check"]).when(F.col("route") == "structured", intent["kind"])
              .when(F.col("route") == "entity", R.entity_candidate("text")))
    return q.withColumn("route", route).select(
        "query_id", "route", F.when(F.col("route") == "search", R.route("text")).alias("collection"), detail.alias("detail"))


def retrieve(routed: DataFrame, search: Callable[[DataFrame, int], DataFrame], threshold: float = fusion.RELEVANCE_THRESHOLD,
             final: int = FINAL) -> tuple[DataFrame, DataFrame]:
    """(first page, decision per question) for the rows that need a search.

    `search(questions, k)` returns query_id, id, score, rank.
    """
    open_rows = routed.filter(F.col("route").isin("search", "search_all"))
    found = search(open_rows, FETCH)
    decision = fusion.gate(found, threshold)
    paged = respcache.pages(found, final, FETCH)
    return paged.filter(F.col("page") == 0), decision


def entity_matches(routed: DataFrame, titles: DataFrame, k: int = 3, threshold: float = TITLE_SHORTCUT) -> DataFrame:
    """Title matches of the entity route: question text, title, similarity."""
    wanted = routed.filter(F.col("route") == "entity").select(F.upper("detail").alias("text")).distinct()
    return setjoin.name_lookup(wanted, titles, threshold, k)


def enrich_titles(chunks: DataFrame, records: DataFrame, threshold: float = TITLE_ENRICH) -> DataFrame:
    """Give chunks without a record id the record whose title is most similar.

    chunks: title, kind, doc_id (nullable); records: title, kind, doc_id. The
    best title of the same kind wins; ties go to the smaller title, then id.
    """
    missing = chunks.filter(F.col("doc_id").isNull() & (F.coalesce("title", F.lit("")) != ""))
    left = missing.select("title", "kind").distinct()
    right = records.groupBy("title", "kind").agg(F.min("doc_id").alias("record_id"))

    def sets(df):
        key = F.to_json(F.struct("kind", "title"))
        return df.select(key.alias("id"), T.word_trigrams("title").alias("tokens")).filter(F.size("tokens") > 0)

    pairs = setjoin.jaccard_join(sets(left), sets(right), threshold)
    kind_title = "kind STRING, title STRING"
    named = pairs.select(F.from_json("left_id", kind_title).alias("l"), F.from_json("right_id", kind_title).alias("r"), "sim")
    same = named.filter(F.col("l.kind") == F.col("r.kind")).select(
        F.col("l.kind").alias("kind"), F.col("l.title").alias("title"), F.col("r.title").alias("match"), "sim")
    best = (same.groupBy("kind", "title").agg(F.min(F.struct((-F.col("sim")).alias("s"), F.col("match"))).alias("b"))
            .select("kind", "title", F.col("b.match").alias("match")))
    found = best.join(right.withColumnRenamed("title", "match"), ["kind", "match"]).select("kind", "title", "record_id")
    return (chunks.join(found, ["kind", "title"], "left")
            .withColumn("doc_id", F.coalesce("doc_id", "record_id")).drop("record_id"))


def area_search(chunks: DataFrame, terms: list[str], people: str = "ufpel_servidores", projects: str = "ufpel_projetos",
                max_people: int = 50, max_projects: int = 5) -> DataFrame:
    """People and projects whose text names any of the terms, one row per title."""
    hit = T.contains_any("text", terms)
    found = chunks.filter(F.col("collection").isin(people, projects) & hit & F.col("title").isNotNull())
    first = found.groupBy("collection", "title").agg(F.min(F.struct("id", "text", "url")).alias("m"))
    rows = first.select("collection", "title", F.col("m.url").alias("url"), T.snippet("m.text", terms).alias("snippet"))
    return (rows.filter(F.col("collection") == people).orderBy("title").limit(max_people)
            .unionByName(rows.filter(F.col("collection") == projects).orderBy("title").limit(max_projects)))
