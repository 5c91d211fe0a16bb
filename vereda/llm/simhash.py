"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Fingerprints within the radius are found exactly. By the pigeonhole principle two fingerprints that differ in at most
`r` bits agree wholly on one of `r + 1` segments, so fingerprints are laid out in one block per segment value and only
blocks are compared within themselves. A block is compared in tiles: arrays of fingerprints of one population count,
combined by exclusive-or and bit counts. Tile pairs whose population counts differ by more than the radius are never
formed, since each differing bit changes the count by one at most. A block of many fingerprints is spread over tasks as
tile pairs; each pair yields a spanning forest of its links instead of all of them, so a dense group costs rows in
proportion to its fingerprints.

Edge cases: a NULL text has no words, hence fingerprint zero, as have blank texts. Rows of one id are separate rows. A
NULL id is returned and links like any other but names no component; a component of NULL ids only is named NULL. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, Scratch, text_class

RADIUS = 2
SHINGLE = 3
#: Fingerprints in a tile. A tile pair holds a matrix of 256 rows by this many columns at a time.
TILE = 2048
_SLICE = 1 << 16
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit i is set if over half of the shingles' XXH64 values (seed 42, repeats included) have it."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = WORD_BYTES.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not found:
        return 0
    if len(found) < size:
        return digest(b" ".join(found), 42)
    ones, total = np.zeros(64, np.int64), len(found) - size + 1
    for at in range(0, total, _SLICE):
        part = found[at:at + _SLICE + size - 1]
        n = len(part) - size + 1
        hashes = np.fromiter((digest(b" ".join(x), 42) for x in zip(*(part[i:] for i in range(size)))), np.uint64, n)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter((fingerprint(t if isinstance(t, str) else None, size) for t in b["text"]), np.uint64, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member reachable from each of n members over the links a-b."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (before == label).all():
            break
    return label


def _pairs(fp: np.ndarray, pop: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius between two lists that rise in population count; tiles of other counts are skipped."""
    heads, tails = [], []
    for at in range(0, len(left), 256):
        rows = left[at:at + 256]
        lo = np.searchsorted(pop[right], pop[rows[0]] - radius, "left")
        hi = np.searchsorted(pop[right], pop[rows[-1]] + radius, "right")
        cols = right[lo:hi]
        i, j = np.nonzero(np.bitwise_count(fp[rows][:, None] ^ fp[cols][None, :]) <= radius)
        i, j = rows[i], cols[j]
        keep = i < j if right is left else slice(None)
        heads.append(i[keep])
        tails.append(j[keep])
    return np.concatenate([*heads, np.zeros(0, int)]), np.concatenate([*tails, np.zeros(0, int)])


def _compare(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links among rows sorted by tile pair; a tile pair that a batch cuts is carried into the next."""
    rest: pd.DataFrame | None = None

    def links(part: pd.DataFrame) -> pd.DataFrame:
        key = part[["seg", "lo", "hi"]].to_numpy()
        node, fp, side = part["node"].to_numpy(), part["fp"].to_numpy().view(np.uint64), part["side"].to_numpy()
        pop = np.bitwise_count(fp).astype(np.int16)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(fp)])
        group = np.repeat(np.arange(len(starts)), sizes)
        heads, tails = [np.zeros(0, int)], [np.zeros(0, int)]
        # Small tile pairs together: each row against the one d places on.
        small = sizes <= 32
        for d in range(1, int(sizes[small].max(initial=1))):
            i = np.flatnonzero((group[d:] == group[:-d]) & small[group[:-d]])
            i = i[(np.abs(pop[i] - pop[i + d]) <= radius) & (np.bitwise_count(fp[i] ^ fp[i + d]) <= radius)]
            heads.append(i)
            tails.append(i + d)
        for g in np.flatnonzero(~small):
            s = slice(starts[g], starts[g] + sizes[g])
            left, right = np.flatnonzero(side[s] == 0), np.flatnonzero(side[s] == 1)
            i, j = _pairs(fp[s], pop[s], left, right if len(right) or key[starts[g], 1] != key[starts[g], 2] else left, radius)
            label = forest(i, j, int(sizes[g]))
            at = np.flatnonzero(label != np.arange(sizes[g]))
            heads.append(starts[g] + label[at])
            tails.append(starts[g] + at)
        a, b = node[np.concatenate(heads)], node[np.concatenate(tails)]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    for batch in batches:
        part = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(part):
            continue
        last = part[["seg", "lo", "hi"]].iloc[-1]
        open_ = (part["seg"] == last["seg"]) & (part["lo"] == last["lo"]) & (part["hi"] == last["hi"])
        cut = len(part) - int(open_.sum())
        rest = part.iloc[cut:]
        if cut:
            yield links(part.iloc[:cut])
    if rest is not None and len(rest):
        yield links(rest)


def links(nodes: DataFrame, scratch: Scratch, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) with a < b: links among nodes (node, fp) that connect what the radius connects."""
    n = radius + 1
    pop = F.bit_count("fp").cast("int")
    width = [64 // n + (i < 64 % n) for i in range(n)]
    segments = []
    for i, w in enumerate(width):
        value = F.shiftrightunsigned("fp", 64 - sum(width[:i + 1])).bitwiseAND(F.lit((1 << w) - 1))
        segments.append(F.struct(F.lit(i).alias("no"), value.alias("value")))
    payload = ["node", "fp", "pop"]
    spread = nodes.withColumn("pop", pop).select(*payload, F.explode(F.array(*segments)).alias("s"))
    spread = spread.select(*payload, (F.col("s.value") * n + F.col("s.no")).alias("seg"))
    # Stored, so that the join below reads two plain exchanges, whose large partitions Spark can split.
    sizes = scratch.put("sizes", spread.groupBy("seg").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    parts = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    laid = spread.join(sizes.select("seg", parts.alias("parts")), "seg")
    zero = F.lit(0)
    small = laid.filter("parts = 1").select(*payload, "seg", zero.alias("lo"), zero.alias("hi"), zero.alias("side"))
    # A tile: a band of population counts as wide as the radius, one of `parts` shares of it. Bands further apart than the
    # next hold no links; a tile meets those of its own band and of the next.
    band = F.floor(F.col("pop") / n).cast("int")
    own = band * F.col("parts") + F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    low, high = F.greatest(zero, band - 1) * F.col("parts"), (F.least(F.lit(64 // n), band + 1) + 1) * F.col("parts") - 1
    met = laid.filter("parts > 1").withColumn("own", own).withColumn("other", F.explode(F.sequence(low, high)))
    large = met.select(*payload, "seg", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                       (F.col("own") > F.col("other")).cast("int").alias("side"))
    keys = ["seg", "lo", "hi"]
    pairs = small.unionByName(large).repartition(*keys).sortWithinPartitions(*keys, "side", "pop")
    return pairs.drop("pop").mapInPandas(lambda it: _compare(it, radius), "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, root): for each node of the links (a, b), a node that all of its component and no other have.

    Each round every node hooks to its smallest neighbour, the hooks are followed to their ends by pointer doubling and
    the links are redrawn between the ends; components at least halve in a round.
    """
    edges = scratch.put(f"{tag}-edges-0", edges)
    label, n = None, 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        hook = scratch.put(f"{tag}-hook-{n}", hook.select("node", F.least("node", "to").alias("to")))
        step = 0
        while True:
            far = hook.select(F.col("node").alias("to"), F.col("to").alias("far"))
            hook2 = scratch.put(f"{tag}-hook-{n}-{step}", hook.join(far, "to", "left").select("node", F.coalesce("far", "to").alias("far"), "to"))
            moved = not hook2.filter("far <> to").isEmpty()
            hook, step = hook2.select("node", F.col("far").alias("to")), step + 1
            if not moved:
                break
        ends = hook.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        out = edges.join(ends, "a").join(ends.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b")
        out = out.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = scratch.put(f"{tag}-edges-{n + 1}", out)
        if label is None:
            label = scratch.put(f"{tag}-label-{n}", hook.select("node", F.col("to").alias("root")))
        else:
            moved = label.join(hook.select(F.col("node").alias("root"), "to"), "root", "left")
            label = scratch.put(f"{tag}-label-{n}", moved.select("node", F.coalesce("to", "root").alias("root")))
        scratch.drop(f"{tag}-edges-{n}", f"{tag}-hook-{n}", *(f"{tag}-hook-{n}-{i}" for i in range(step)), f"{tag}-label-{n - 1}")
        n += 1
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """doc_id, fp (signed long), component_id: one row per row of docs."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.put("prints", fingerprints(docs, size))
    known = scratch.put("known", prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(known.select(F.col("fp").alias("node"), "fp"), scratch, radius, tile), scratch)
    named = known.join(roots, known["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = scratch.put("named", named)
    least = scratch.put("least", named.groupBy("root").agg(F.min("first_id").alias("component_id")))
    members = scratch.put("members", named.join(least, "root").select("fp", "component_id"))
    scratch.drop("known", "named", "least")
    return prints.join(members, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The result of query op9_simhash."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class Shingles:
    """64-bit hashes of a text's word shingles; the hashes of words are kept from text to text."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def names(self, text: str | None) -> np.ndarray:
        import xxhash

        found = WORD_BYTES.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
        if len(self.known) > 150_000:
            self.known.clear()
        for w in set(found).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))

    def distinct(self, text: str | None, size: int) -> np.ndarray:
        """Ascending distinct hashes of the text's shingles; fewer words than a shingle has: of the whole sequence."""
        names = self.names(text)
        return np.unique(self.hashes(names, size)) if len(names) else np.zeros(0, np.uint64)

    @staticmethod
    def hashes(names: np.ndarray, size: int) -> np.ndarray:
        n, base = max(1, len(names) - size + 1), np.uint64(0x9E3779B97F4A7C15)
        out = np.zeros(n, np.uint64)
        for k in range(min(size, len(names))):
            out = out * base + names[k:k + n]
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
        return out ^ (out >> np.uint64(33))


def _classed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_class("text").alias("class"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.filter("doc_id IS NOT NULL")


def described(docs: DataFrame) -> DataFrame:
    """doc_id, class, fp (of two-word shingles)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles()
        for b in batches:
            prints = []
            for text in b["text"]:
                two, ones = shingles.hashes(shingles.names(text), 2), np.zeros(64, np.int64)
                for at in range(0, len(two), _SLICE):
                    bits = two[at:at + _SLICE].view(np.uint8).reshape(-1, 8)
                    ones += np.unpackbits(bits, axis=1, bitorder="little").sum(0, dtype=np.int64)
                prints.append(int(np.packbits(ones * 2 > len(two), bitorder="little").view(np.int64)[0]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "class": b["class"], "fp": prints})

    return _classed(docs).mapInPandas(run, "doc_id long, class binary, fp long")
