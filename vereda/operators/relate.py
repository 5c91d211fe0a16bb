"""Relational building blocks shared by the views.

Bridges are aggregated before they are joined, so an entity with several
bridges never fans out to their product.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from . import scan

#: Fixed value: what stands between name and role of a team entry.
MEMBER_MARK = " — "


def distinct_arrays(base: DataFrame, key: str, parts: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Left-join sorted arrays of distinct non-NULL values; no match gives [].

    parts: output name -> (frame with `key`, value column).
    """
    out = base
    for name, (frame, value) in parts.items():
        pairs = frame.select(key, F.col(value).alias("__v")).filter(F.col("__v").isNotNull()).distinct()
        arr = pairs.groupBy(key).agg(F.array_sort(F.collect_set("__v")).alias(name))
        kind = arr.schema[name].dataType.simpleString()
        out = out.join(arr, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def left_many(base: DataFrame, many: DataFrame, key: str) -> DataFrame:
    """Left join where one key may match very many rows.

    An inner join can be split on either side when a key is skewed, an outer
    join cannot split its optional side; rows without a match are added apart.
    """
    alone = base.join(many.select(key).distinct(), key, "left_anti")
    return base.join(many, key).unionByName(alone, allowMissingColumns=True)


def ordered_text(df: DataFrame, keys: list[str], label: Column, order: Column, out: str, sep: str = ", ") -> DataFrame:
    """Distinct labels per key joined in order of first appearance."""
    firsts = df.groupBy(*keys, label.alias("__l")).agg(F.min(order).alias("__o"))
    return firsts.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("__o", "__l"))), lambda s: s["__l"]), sep).alias(out))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int | None) -> DataFrame:
    """First n rows per key, all if n is None; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("ord", F.row_number().over(w))
    return ranked if n is None else ranked.filter(F.col("ord") <= n)


def tree_paths(edges: DataFrame, *, item: str, parent: str, title: str, sep: str = " › ") -> DataFrame:
    """Every item reachable from a root (NULL parent) with its title path and level.

    Levels are joined one at a time; each new level is checkpointed, so the
    plan stays short and a lost executor does not replay the whole walk. The walk
    ends with the first empty level: an item has one parent, so a cycle has no root.
    """
    e = edges.select(F.col(item).alias("item"), F.col(parent).alias("parent"), F.col(title).alias("title"))
    level = e.filter(F.col("parent").isNull()).select("item", F.col("title").alias("path"), F.lit(0).alias("level"))
    levels = [level]
    children = e.filter(F.col("parent").isNotNull())
    for depth in count(1):
        above = levels[-1].select(F.col("item").alias("parent"), F.col("path").alias("above"))
        nxt = session.checkpoint(children.join(above, "parent").select(
            "item", F.concat("above", F.lit(sep), "title").alias("path"), F.lit(depth).alias("level")))
        if nxt.isEmpty():
            break
        levels.append(nxt)
    return reduce(DataFrame.unionByName, levels)


def ancestor_paths(pages: DataFrame, *, item: str, parent: str, slug: str, sep: str = "/") -> DataFrame:
    """Slug path from the top ancestor down to each page.

    The walk of a page stops at a missing parent or at a page already visited.
    """
    step = pages.select(F.col(item).alias("up"), F.col(parent).alias("next_up"), F.col(slug).alias("up_slug"))
    state = pages.select(F.col(item).alias("item"), F.col(slug).alias("path"), F.col(parent).alias("up"),
                         F.array(F.col(item)).alias("seen"))
    done = []
    while True:
        moved = state.join(step, "up", "left")
        stop = F.col("up_slug").isNull() | F.array_contains("seen", F.col("up"))
        moved = session.checkpoint(moved.withColumn("stop", F.coalesce(stop, F.lit(True))))
        done.append(moved.filter("stop").select("item", "path"))
        state = moved.filter("NOT stop").select(
            "item", F.concat("up_slug", F.lit(sep), "path").alias("path"), F.col("next_up").alias("up"),
            F.concat("seen", F.array("up")).alias("seen"))
        if state.isEmpty():
            return reduce(DataFrame.unionByName, done)


def projects_of_people(people: DataFrame, projects: DataFrame, members: DataFrame, per_person: int = 5) -> DataFrame:
    """Projects of each question's people: as coordinator, then as member.

    people: question, person. projects: project, coordinator, start.
    members: project, person. A question shows at most per_person x people
    rows; members count only when coordinators fill less than half of that, and
    never through a project without coordinator or one already led by them.
    """
    people = people.select("question", "person").distinct()
    limits = people.groupBy("question").agg((F.count("*") * per_person).alias("lim"))
    led = projects.join(people.withColumnRenamed("person", "coordinator"), "coordinator").select(
        "question", "project", "coordinator", "start")

    latest = F.lit((1 << 63) - 1)

    def ranked(df: DataFrame) -> DataFrame:
        # Projects without a start come last.
        block = F.coalesce(-F.datediff("start", F.lit("1970-01-01")), F.lit((1 << 31) - 1))
        return scan.numbered(df, ["question"], ["neg", "project"], "ord", block)

    led = ranked(led.withColumn("neg", F.coalesce(-F.unix_micros(F.col("start").cast("timestamp")), latest))).join(limits, "question").filter(
        F.col("ord") <= F.col("lim"))
    counts = limits.join(led.groupBy("question").agg(F.count("*").alias("got")), "question", "left").select(
        "question", (F.col("lim") - F.coalesce("got", F.lit(0))).alias("room"),
        (F.coalesce("got", F.lit(0)) < F.floor(F.col("lim") / 2)).alias("short"))
    hungry = counts.filter("short")
    asked = people.join(hungry.select("question"), "question", "left_semi")
    via = (members.join(asked, "person").select("question", "project").distinct()
           .join(projects.filter(F.col("coordinator").isNotNull()), "project"))
    own = people.withColumnRenamed("person", "coordinator")
    via = via.join(own, ["question", "coordinator"], "left_anti")
    member = ranked(via.withColumn("neg", F.coalesce(-F.unix_micros(F.col("start").cast("timestamp")), latest))).join(hungry, "question").filter(
        F.col("ord") <= F.col("room"))
    return (led.select("question", "project", F.lit("coordenador").alias("role"))
            .unionByName(member.select("question", "project", F.lit("membro").alias("role"))))


def team_members(projects: DataFrame, people: DataFrame, project: str = "project", team: str = "team") -> DataFrame:
    """(project, person): the people whose name is the upper-cased first part of a team entry "name — role".

    people: person, name. Entries are split before they meet the names; several people of one name are all members, one
    entry met twice counts once. NULL entries, empty teams and NULL names match nothing.
    """
    entries = projects.select(F.col(project).alias("project"), F.explode(team).alias("entry"))
    named = entries.select("project", F.upper(F.substring_index("entry", MEMBER_MARK, 1)).alias("name")).distinct()
    return named.join(people.select("person", F.upper("name").alias("name")), "name").select("project", "person").distinct()


def dossier(sections: list[tuple[str, DataFrame, str, Column, list[Column], int | None]]) -> DataFrame:
    """Long frame (key, section, ord, payload) from (name, frame, key, payload, order, limit)."""
    parts = []
    for name, frame, key, payload, order, n in sections:
        rows = frame.select(F.col(key).alias("key"), payload.alias("payload"),
                            *[o.alias(f"__o{i}") for i, o in enumerate(order)])
        top = top_per_key(rows, ["key"], [F.col(f"__o{i}") for i in range(len(order))], n)
        parts.append(top.select("key", F.lit(name).alias("section"), "ord", "payload"))
    return reduce(DataFrame.unionByName, parts)


def table_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(table, n) of each frame."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in frames.items()])
