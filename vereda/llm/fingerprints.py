"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct hashes of a text's word shingles. Sketches of parts merge into the sketch of the
whole by keeping the k smallest of both. The share of common hashes among the k smallest of two sketches' union estimates
the resemblance (Jaccard) of the shingle sets; with the distinct count, read off the k-th smallest hash, it gives their
containment. Sets of at most k shingles are compared exactly.

Everything is built-in column functions. Comparing each document with its successor takes one exchange of the texts, by
blocks of consecutive ids; the first document of each block, one in some hundred, is joined to the block before.

Edge cases: a NULL text is the empty text. A text with fewer words than a shingle has one shingle, the whole; one without
words has none, and two empty sets have likeness 1, an empty and another 0. NULL ids come last in descending order; rows
of one id follow each other by text. A single document is its own successor. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHINGLE, K = 5, 256
#: Segments of ids that hold about as many rows each, and rows of a block within one.
SEGMENTS, BLOCK = 512, 256


def shingles(text: F.Column, size: int = SHINGLE) -> F.Column:
    """64-bit hashes of the shingles, repeats included."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashed(w: F.Column) -> F.Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(size))))
        return F.when(F.size(w) >= size, each).when(F.size(w) > 0, F.array(F.xxhash64(w))) \
            .otherwise(F.array().cast("array<bigint>"))

    # The words are bound to a name so that each text is split once.
    return F.get(F.transform(F.array(found), hashed), F.lit(0))


def sketch(text: F.Column, size: int = SHINGLE, k: int = K) -> F.Column:
    return F.slice(F.sort_array(F.array_distinct(shingles(text, size))), 1, k)


def merge(a: F.Column, b: F.Column, k: int = K) -> F.Column:
    """The sketch of what two sketches' texts hold together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: F.Column, b: F.Column, k: int = K) -> F.Column:
    both = merge(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(a, b), both)).cast("double")
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def distinct_count(a: F.Column, k: int = K) -> F.Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: F.Column, b: F.Column, k: int = K) -> F.Column:
    """Estimated share of the shingles of a that b has."""
    j, n, m = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (n + m) / (1 + j) / n))


def encoded(a: F.Column) -> F.Column:
    """A sketch as text: base 64 of its hashes in order, eight bytes each, highest first."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def _blocks(rows: DataFrame) -> DataFrame:
    """rows with `segment` and `block`, both rising with doc_id."""
    facts = rows.agg(F.percentile_approx("doc_id", [i / SEGMENTS for i in range(SEGMENTS)], 20_000).alias("cuts"),
                     F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")).first()
    cuts = sorted(set(facts["cuts"] or []))
    if not cuts:
        return rows.withColumn("segment", F.lit(-1)).withColumn("block", F.lit(-1).cast("long"))
    parts = max(1, facts["n"] // (SEGMENTS * BLOCK))
    ends = [*cuts[1:], facts["top"] + 1]
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    below = F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))) - 1
    rows = rows.withColumn("segment", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.greatest(below, F.lit(0))))
    if parts == 1:
        return rows.withColumn("block", F.col("segment").cast("long"))
    low = F.get(bounds, F.col("segment"))
    wide = F.get(F.array(*[F.lit(max(1, e - c)).cast("long") for c, e in zip(cuts, ends)]), F.col("segment"))
    within = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor((F.col("doc_id") - low).cast("double") / wide * parts)))
    return rows.withColumn("block", F.coalesce(F.col("segment").cast("long") * parts + within, F.lit(-1).cast("long")))


def digest(docs: DataFrame, size: int = SHINGLE, k: int = K) -> DataFrame:
    """The result of query op2_fingerprints."""
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _blocks(rows)
    # The first document of each block, and for each block the first document after its last.
    first = F.max(F.struct(F.col("doc_id"), "text"))
    heads = rows.groupBy("segment", "block").agg(first.alias("head"))
    heads = scratch.put("heads", heads.select("segment", "block", F.col("head.text").alias("text")))
    down = Window.partitionBy("segment").orderBy(F.desc("block"))
    chain = heads.select("segment", "block", F.lead("block").over(down).alias("follows"))
    # One row per segment, of which there are at most SEGMENTS + 1.
    tops = heads.groupBy("segment").agg(F.max("block").alias("top")).limit(SEGMENTS + 1)
    every = Window.orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select("segment", F.lead("top").over(Window.orderBy(F.desc("segment"))).alias("lower"), F.first("top").over(every).alias("highest"))
    chain = chain.join(tops, "segment").select("block", F.coalesce("follows", "lower", "highest").alias("next"))
    after = heads.select(F.col("block").alias("next"), F.col("text").alias("after"))
    ends = scratch.put("ends", chain.join(after, "next").select("block", "after", sketch(F.col("after"), size, k).alias("after_print")))

    order = Window.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))
    rows = rows.select("block", "doc_id", "text", F.lead("text").over(order).alias("follows")).join(ends, "block")
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("follows", "after"), F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows = rows.select(
        "block", "doc_id", "text", "after_print", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        sketch(F.col("text"), size, k).alias("own"), sketch(F.col("edited"), size, k).alias("changed"))
    rows = rows.withColumn("next", F.coalesce(F.lead("own").over(order), F.col("after_print")))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", encoded(F.col("own")).alias("fingerprint"),
        encoded(F.col("changed")).alias("edited_fingerprint"), resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("next"), k).alias("near_next"))
