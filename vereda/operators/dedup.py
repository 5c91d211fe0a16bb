"""Duplicate handling and referential integrity.

Every "keep one row per key" is an aggregation over (order, row) structs, so
partial results are combined before the shuffle and a key holding a large share
of the rows never lands whole in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str | Column], order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """The first row per key under `order` (smaller first; NULL keys are equal)."""
    columns = columns or df.columns
    row = F.struct(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"),
                   F.struct(*[F.col(c) for c in columns]).alias("r"))
    names = [F.col(k) if isinstance(k, str) else k for k in keys]
    grouped = df.groupBy(*[n.alias(f"__k{i}") for i, n in enumerate(names)])
    return grouped.agg(F.min(row).alias("m")).select("m.r.*")


def longest(df: DataFrame, key, text: str, seq: str, columns: list[str] | None = None) -> DataFrame:
    """Per key the row with the longest text, the earliest on ties; `columns` are those wanted of it."""
    return keep_one(df, [key], [-F.length(F.coalesce(F.col(text), F.lit(""))), F.col(seq)], columns)


def richness(df: DataFrame, columns: list[str]) -> Column:
    """Number of columns holding a value; '', [] and {} do not count."""
    total = F.lit(0)
    for c in columns:
        kind = df.schema[c].dataType.typeName()
        col = F.col(c)
        if kind == "string":
            full = col.isNotNull() & (col != "")
        elif kind in ("array", "map"):
            full = col.isNotNull() & (F.size(col) > 0)
        else:
            full = col.isNotNull()
        total = total + F.when(full, 1).otherwise(0)
    return total


def richest(df: DataFrame, keys: list[str], seq: str, measured: list[str] | None = None) -> DataFrame:
    """Per key the row with most filled columns; ties keep the first."""
    cols = measured or [c for c in df.columns if c not in keys and c != seq]
    return keep_one(df, keys, [-richness(df, cols), F.col(seq)])


def merge_first(df: DataFrame, keys: list[str], seq: str, columns: list[str]) -> DataFrame:
    """Per key and column the first non-empty value in `seq` order."""
    def filled(c: str) -> Column:
        col = F.col(c)
        return (col.isNotNull() & (col != "")) if df.schema[c].dataType.typeName() == "string" else col.isNotNull()

    return df.groupBy(*keys).agg(*[F.min_by(F.when(filled(c), F.col(c)), F.when(filled(c), F.col(seq))).alias(c)
                                   for c in columns])


def most_recent(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """First row per key under `order`; pass negated columns for descending."""
    return keep_one(df, keys, order)


def duplicate_keys(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Keys that occur more than once (NULLs coalesced by the caller or equal)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def resolve_ids(rows: DataFrame, by_key: tuple[str, DataFrame], by_name: tuple[str, DataFrame], target: str) -> DataFrame:
    """Fill `target`: own value, else by key, else by name.

    Each lookup is (column, frame with that column, `seq` and `id`); the last
    row of a lookup wins.
    """
    out = rows
    found = []
    for i, (col, frame) in enumerate((by_key, by_name)):
        last = frame.groupBy(col).agg(F.max_by("id", "seq").alias(f"__id{i}"))
        out = out.join(last, col, "left")
        found.append(F.col(f"__id{i}"))
    how = (F.when(F.col(target).isNotNull(), "given").when(found[0].isNotNull(), "key")
           .when(found[1].isNotNull(), "name"))
    return (out.withColumn("resolved_by", how).withColumn(target, F.coalesce(F.col(target), *found))
            .drop("__id0", "__id1"))


def derived_bridge(existing: DataFrame, derived: DataFrame, keys: list[str], origin: str) -> DataFrame:
    """`existing` plus the derived pairs it lacks, tagged with `origin`."""
    tagged = derived.select(*keys).distinct().withColumn("origin", F.lit(origin))
    fresh = tagged.join(existing.select(*keys).distinct(), keys, "left_anti")
    return existing.select(*keys, "origin").unionByName(fresh)


def prune(df: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key exists in `parent`."""
    return df.join(parent.select(*keys).distinct(), keys, "left_semi")


def orphans(df: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(parent.select(*keys).distinct(), keys, "left_anti")


def null_dangling(df: DataFrame, col: str, parent: DataFrame, flag: str | None = None) -> DataFrame:
    """Set `col` to NULL (and `flag` to false) where it has no parent row."""
    known = parent.select(F.col(col)).distinct().withColumn("__known", F.lit(True))
    out = df.join(known, col, "left")
    keep = F.col("__known").isNotNull()
    if flag:
        out = out.withColumn(flag, F.when(keep, F.col(flag)).otherwise(F.lit(False)))
    return out.withColumn(col, F.when(keep, F.col(col))).drop("__known")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: list[str] = ()) -> DataFrame:
    """Insert-or-update: new values win except in `keep_old` columns.

    Columns in `keep_old` take the new value only where the old one is NULL or
    the row is new.
    """
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in values], F.lit(True).alias("o_has"))
    n = new.select(*keys, *[F.col(c).alias(f"n_{c}") for c in values], F.lit(True).alias("n_has"))
    j = o.join(n, keys, "full_outer")
    cols = []
    for c in values:
        if c in keep_old:
            v = F.when(F.col("o_has").isNotNull(), F.coalesce(f"o_{c}", f"n_{c}")).otherwise(F.col(f"n_{c}"))
        else:
            v = F.when(F.col("n_has").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
        cols.append(v.alias(c))
    return j.select(*keys, *cols)


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert that replaces whole rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def union_by_columns(frames: list[DataFrame]) -> DataFrame:
    """Stack rows whose column sets differ; missing values are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
