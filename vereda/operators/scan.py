"""Order-dependent scans that stay parallel inside one long sequence.

A sequence is cut into blocks of its own order value (turns by count, events by
time). Each (key, block) is scanned alone; only one summary row per block is
ordered per key to carry state across. Hot keys therefore split over tasks.
NULL keys form a group of their own, and NULL order values a block of theirs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_block(local: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the state before its block; NULL keys and NULL blocks match each other."""
    names = [*keys, "__block"]
    held = before.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(names)], "__before")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(names)])
    return local.join(held, on).drop(*[f"__k{i}" for i in range(len(names))])


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str,
                  block: Column) -> DataFrame:
    """`out` = last non-NULL `value` at or before each row of its key.

    `block` must not decrease along `order`.
    """
    b = df.withColumn("__block", block).withColumn("__v", value)
    inside = (Window.partitionBy(*keys, "__block").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = b.withColumn("__local", F.last("__v", ignorenulls=True).over(inside))
    seen = F.col("__v").isNotNull()
    last = (b.groupBy(*keys, "__block")
            .agg(F.max_by(F.when(seen, F.col("__v")), F.when(seen, F.struct(*order))).alias("__last")))
    across = (Window.partitionBy(*keys).orderBy("__block")
              .rowsBetween(Window.unboundedPreceding, -1))
    before = last.withColumn("__before", F.last("__last", ignorenulls=True).over(across)).drop("__last")
    return (_with_block(local, before, keys).withColumn(out, F.coalesce("__local", "__before"))
            .drop("__block", "__v", "__local", "__before"))


def running_count(df: DataFrame, keys: list[str], order: list[str], hit: Column, out: str, block: Column) -> DataFrame:
    """`out` = number of rows with `hit` at or before each row of its key."""
    b = df.withColumn("__block", block).withColumn("__h", F.when(hit, 1).otherwise(0))
    inside = (Window.partitionBy(*keys, "__block").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = b.withColumn("__local", F.sum("__h").over(inside))
    sums = b.groupBy(*keys, "__block").agg(F.sum("__h").alias("__s"))
    across = (Window.partitionBy(*keys).orderBy("__block")
              .rowsBetween(Window.unboundedPreceding, -1))
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(across), F.lit(0))).drop("__s")
    return (_with_block(local, before, keys)
            .withColumn(out, F.col("__local") + F.col("__before"))
            .drop("__block", "__h", "__local", "__before"))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, block: Column) -> DataFrame:
    """`out` = sum of `value` at or before each row of its key; NULL values add nothing."""
    b = df.withColumn("__block", block).withColumn("__h", F.coalesce(value, F.lit(0)))
    inside = (Window.partitionBy(*keys, "__block").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = b.withColumn("__local", F.sum("__h").over(inside))
    sums = b.groupBy(*keys, "__block").agg(F.sum("__h").alias("__s"))
    across = (Window.partitionBy(*keys).orderBy("__block")
              .rowsBetween(Window.unboundedPreceding, -1))
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(across), F.lit(0))).drop("__s")
    return (_with_block(local, before, keys)
            .withColumn(out, F.col("__local") + F.col("__before"))
            .drop("__block", "__h", "__local", "__before"))


def previous(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, block: Column) -> DataFrame:
    """`out` = `value` of the preceding row of the same key (NULL on the first)."""
    b = df.withColumn("__block", block).withColumn("__v", F.struct(value.alias("v")))
    inside = Window.partitionBy(*keys, "__block").orderBy(*order)
    local = b.withColumn("__local", F.lag("__v").over(inside))
    last = b.groupBy(*keys, "__block").agg(F.max_by("__v", F.struct(*order)).alias("__last"))
    across = Window.partitionBy(*keys).orderBy("__block")
    before = last.withColumn("__before", F.lag("__last").over(across)).drop("__last")
    return (_with_block(local, before, keys)
            .withColumn(out, F.coalesce("__local", "__before")["v"])
            .drop("__block", "__v", "__local", "__before"))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, block: Column) -> DataFrame:
    """1-based position of each row within its key."""
    return running_count(df, keys, order, F.lit(True), out, block)
