"""Sharding by histogram sort: shards of near equal bytes in the order of a 64-bit hash of the text.

Rows are ordered by (hash of text, hash of id), so equal texts lie side by side. The borders between shards are found by
probing: a round counts, over all partitions, the exact bytes in each bin between candidate borders; only bins that a
border still falls into are probed again, split some 8000-fold, until every border is within tolerance of its target.
Borders between texts are preferred, so a group of equal texts is cut only where it is itself larger than the tolerance;
then the probing goes on in the hash of the id. What comes to the driver is bounded by borders times bins.

The rows, without their texts, are then exchanged once, by shard and cell: a cell is a bin of the first round, dealt out
further where it holds far more rows than others. Slots number a shard's rows cell by cell.

Edge cases: a NULL text has size 8 and the checksum of the empty text; a NULL id hashes like any other value. Rows that
agree in text and id cannot be told apart by a border and share a shard. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARDS = 24
#: A border may miss its target by this share of a shard's bytes.
TOLERANCE = 0.005
#: Bits of a 64-bit key resolved before and after each round of probes.
ROUNDS = ((0, 12), (12, 25), (25, 38), (38, 51), (51, 64))
_SIGN = 1 << 63


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort keys k1 (text) and k2 (id), both in signed order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit("id"), "doc_id").alias("k2"))


def _top(key: str, bits: int) -> F.Column:
    """The highest bits of a key as a number from 0, in the key's signed order; all 64 are read as unsigned."""
    return F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(-_SIGN)), 64 - bits)


def borders(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """Shard s + 1 begins at the s-th pair (k1, k2); pairs are numbers from 0 to 2 ** 64 in the keys' order."""
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        return []
    slack = tolerance * total / shards
    want = {s: total * (s + 1) / shards for s in range(shards - 1)}
    found: dict[int, tuple[int, int]] = {}
    # Of each border not yet placed: the bin it falls into, as (whole k1 or None, highest bits so far), and the bytes below.
    bins: dict[int, tuple[int | None, int]] = {s: (None, 0) for s in want}
    below = dict.fromkeys(want, 0)
    for key in ("k1", "k2"):
        for done, upto in ROUNDS:
            if not bins:
                break
            part = rows
            if key == "k2":
                part = part.filter(F.col("k1").isin(sorted({b[0] - _SIGN for b in bins.values()})))
            if done:
                part = part.filter(_top(key, done).isin(sorted({b[1] for b in bins.values()})))
            group = F.col("k1") if key == "k2" else F.lit(None).cast("long")
            counts: dict[tuple, list] = {}
            for g, top, size in part.groupBy(group.alias("g"), _top(key, upto).alias("top")).agg(F.sum("size")).collect():
                top %= 1 << upto
                bin_ = (None if g is None else g + _SIGN, top >> (upto - done))
                counts.setdefault(bin_, []).append((top, size))
            later = {}
            for s, bin_ in bins.items():
                base, left = below[s], 64 - upto
                for top, size in sorted(counts.get(bin_, ())):
                    if base + size >= want[s]:
                        break
                    base += size
                miss, at = min((want[s] - base, top << left), (base + size - want[s], (top + 1) << left))
                below[s] = base
                if miss <= slack or (key == "k2" and not left):
                    found[s] = (at, 0) if key == "k1" else (bin_[0], at)
                else:
                    later[s] = (top, 0) if key == "k1" and not left else (bin_[0], top)
            bins = later
    return sorted(found.values())


def shard(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """rows with their shard: the number of borders at or below their keys."""
    number = F.lit(0)
    for a, b in cuts:
        if a >= 2 * _SIGN:
            continue
        after = F.col("k1") > F.lit(a - _SIGN)
        same = F.col("k1") == F.lit(a - _SIGN)
        at = F.lit(False) if b >= 2 * _SIGN else F.col("k2") >= F.lit(b - _SIGN)
        number = number + (after | (same & at)).cast("int")
    return rows.withColumn("shard", number)


def slots(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with `slot`: their number within the shard, gapless from 0."""
    rows = rows.withColumn("cell", _top("k1", ROUNDS[0][1]).cast("int"))
    sizes = scratch.put("cells", rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")))
    usual = max(64.0, 4.0 * (sizes.agg(F.avg("n")).first()[0] or 0.0))
    # Fewer than a quarter of the at most 4096 + shards cells hold over four times the average: a bounded broadcast.
    large = sizes.filter(F.col("n") > usual).select("shard", "cell", F.ceil(F.col("n") / usual * 2).alias("parts"))
    rows = rows.join(F.broadcast(large), ["shard", "cell"], "left")
    rows = rows.withColumn("part", F.pmod("k2", F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    parts = scratch.put("parts", rows.groupBy("shard", "cell", "part").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.put("offsets", parts.select("shard", "cell", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    own = Window.partitionBy("shard", "cell", "part").orderBy("k1", "k2", "doc_id")
    numbered = rows.withColumn("nth", F.row_number().over(own))
    return numbered.join(offsets, ["shard", "cell", "part"]).withColumn("slot", F.col("offset") + F.col("nth") - 1)


def digest(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The result of query op8_sharding."""
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.put("rows", keyed(docs))
    out = slots(shard(rows, borders(rows, shards, tolerance)), scratch)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
