"""Near copies on word shingles: SimHash tiles propose, bands of signatures propose the rest, whole sets decide.

Fingerprints within a narrow radius are found by the tiled comparison of `simhash`; they are the near copies that differ
little. Copies further apart are met in the buckets of `minhash`, which two sets of resemblance 0.8 miss with a probability
below 1e-6. Every link is confirmed on whole shingle sets, so texts below the resemblance are never joined.

Texts are the nodes, named by 128 bits; so several texts under one id, or several ids of one text, do no harm.

Edge cases: NULL reads as the empty text; equal texts are copies, blank ones too, but share no links with others. Rows
without an id are kept. Extra columns are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash, simhash
from .common import Scratch, text_class

#: Words of a shingle, bits between the fingerprints (of two-word shingles) that the tiles propose.
SHINGLE, RADIUS = 5, 3
#: Rows of an Arrow batch: rows carry whole texts or whole sets, two of them where a link is confirmed.
BATCH = 1_000


def proposals(docs: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of text classes that connect what the radius connects."""
    prints = scratch.put("prints", simhash.described(docs).groupBy("class").agg(F.first("fp").alias("fp")))
    heads = scratch.put("heads", prints.groupBy("fp").agg(F.min("class").alias("head")))
    links = simhash.links(heads.select(F.col("fp").alias("node"), "fp"), scratch, radius)
    of = lambda fp, name: heads.select(F.col("fp").alias(fp), F.col("head").alias(name))
    apart = links.join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    equal = prints.join(heads, "fp").filter("class <> head").select(F.col("head").alias("a"), F.col("class").alias("b"))
    return scratch.put("proposed", apart.union(equal))


def representatives(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, **how) -> DataFrame:
    """One row of each group of near copies, that of the least id, with the columns of docs.

    Near copies share at least 0.8 of their shingles. Of several texts or rows under a group's least id one stays. A group
    without any id, and rows without an id, stay as they are.
    """
    scratch = Scratch(docs.sparkSession, "nearcopies", BATCH)
    found = minhash.linked(docs, scratch, size, proposed=proposals(docs, scratch, radius), **how)
    scratch.drop("prints", "heads", "proposed")
    first = found.filter("first_id IS NOT NULL").groupBy("root").agg(F.min(F.struct("first_id", "class")).alias("first"))
    kept = scratch.put("kept", first.select(F.col("first.class").alias("_class"), F.col("first.first_id").alias("_first")))
    scratch.drop("found")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), text_class("text").alias("_class"))
    stay = rows.join(kept, "_class").filter("_id = _first")
    if not rows.filter("_id IS NOT NULL").groupBy("_class", "_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        stay = stay.dropDuplicates(["_class"])
    return stay.select("_row").unionByName(rows.filter("_id IS NULL").select("_row")).select("_row.*")
