"""Mixing sources to target weights by Poisson replication.

A source of n documents with target share w of a mixture of N is repeated at the mean rate w N / n. Each document draws
its number of copies from the Poisson distribution of that mean by inversion: a hash of its id and a seed is a uniform
number, and the copies are the count of distribution values at or below it. The draw depends on nothing else, so a lost
task draws the same again. Each copy has a hash of its own by which all are sorted into a global shuffle.

The only grouping is a count per source, combined before its shuffle; the rates then meet the documents in a join that
Spark broadcasts if they are few and splits where one source is large.

Edge cases: documents without a source are a source of their own. A NULL id draws like any other value, repeated rows
draw alike. Sources of weight zero, and those that explicit targets leave out, give no copies. An empty table gives an
empty result. All other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SEED = 17
#: Target shares are proportional to n ** TEMPERATURE unless they are given.
TEMPERATURE = 0.5
#: Bits of the hashes.
BITS = 48


def hashed(*parts: F.Column, seed: int) -> F.Column:
    """The first 48 bits of an MD5 of the parts as a long."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def rates(docs: DataFrame, targets: Mapping[str, float] | None = None, temperature: float = TEMPERATURE,
          size: int | None = None) -> DataFrame:
    """source, rate: mean copies per document. size: documents wanted in all, as many as there are if None."""
    if targets is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for source, share in sorted(targets.items()):
            weight = F.when(F.col("source") == source, F.lit(float(share))).otherwise(weight)
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("weight", weight)
    whole = counts.agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).first()
    total, wanted = whole["weight"] or 1.0, whole["n"] or 0 if size is None else size
    return counts.select("source", (F.lit(float(wanted)) * F.col("weight") / F.lit(float(total)) / F.col("n")).alias("rate"))


def quantile(rate: F.Column, u: F.Column) -> F.Column:
    """The count of k with P(X <= k) <= u, for u of BITS bits: beyond the last k below, no such u is reached."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")

    def step(s: F.Column, k: F.Column) -> F.Column:
        total = s["total"] + F.exp(s["term"])
        return F.struct((s["term"] + F.log(rate / (k + 1))).alias("term"), total.alias("total"),
                        (s["n"] + (total <= u).cast("int")).alias("n"))

    start = F.struct((-rate).alias("term"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), last), start, step, lambda s: s["n"])).otherwise(F.lit(0))


def replicate(docs: DataFrame, targets: Mapping[str, float] | None = None, temperature: float = TEMPERATURE,
              size: int | None = None, seed: int = SEED) -> DataFrame:
    """row (struct of the columns of docs), copy (from 1), n_copies, key: one row per copy, sorted by the key."""
    scratch = Scratch(docs.sparkSession, "mixing")
    table = scratch.put("rates", rates(docs.select("source"), targets, temperature, size)).withColumnRenamed("source", "of")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    source, doc_id = F.col("row.source"), F.col("row.doc_id")
    # NULL sources meet through an extra key column.
    left = rows.withColumn("named", F.coalesce(source, F.lit(""))).withColumn("none", source.isNull())
    right = table.select(F.coalesce("of", F.lit("")).alias("named"), F.col("of").isNull().alias("none"), "rate")
    u = hashed(doc_id, seed=seed).cast("double") / F.lit(float(1 << BITS))
    drawn = left.join(right, ["named", "none"]).withColumn("n_copies", quantile(F.col("rate"), u))
    each = drawn.filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    key = hashed(doc_id, F.col("copy"), seed=seed + 1)
    return each.select("row", "copy", "n_copies", key.alias("key")).orderBy("key", doc_id, "copy")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture with the columns of docs."""
    return replicate(docs, **options).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """The result of query op3_mixing."""
    out = replicate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source"))
    return out.select("row.doc_id", "row.source", "copy", "n_copies", F.col("key").alias("shuffle_key"))


ORACLE = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (
  SELECT source, (SELECT sum(n) FROM n)::DOUBLE * pow(n, {TEMPERATURE}) / (SELECT sum(pow(n, {TEMPERATURE})) FROM n) / n AS rate
  FROM n),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM r),
cdf AS (
  SELECT source, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM k),
u AS (
  SELECT doc_id, source, ('0x' || substr(md5('{SEED}:' || doc_id), 1, {BITS // 4}))::BIGINT / pow(2, {BITS}) AS u FROM documents),
d AS (
  SELECT u.doc_id, u.source, count(*) AS n_copies
  FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= u.u GROUP BY ALL),
e AS (SELECT doc_id, source, n_copies, unnest(range(1, n_copies + 1)) AS copy FROM d)
SELECT doc_id, source, copy, n_copies,
  ('0x' || substr(md5('{SEED + 1}:' || doc_id || ':' || copy), 1, {BITS // 4}))::BIGINT AS shuffle_key
FROM e
"""
