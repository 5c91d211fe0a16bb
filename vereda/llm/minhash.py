"""MinHash near-duplicates: SuperMinHash signatures, banding, exact verification, union-find over rounds.

A SuperMinHash signature gives each element of a set a random permutation of the signature's places, one place a level:
at level j the element offers `j + r` (r uniform in [0, 1)) to one place, so offers of a level never fall on the same place
and estimates vary less than with independent hashes. No later level can lower a place once every place holds an offer of
an earlier one, so a set stops after about `m ln m / n` levels. Levels run over many documents at a time.

Signatures are cut into bands; a document is named once in the bucket of each of its bands. With the default 60 bands of 7
places two sets of resemblance 0.8 share no bucket with a probability below 1e-6. Buckets are never written out as pairs:

1. every member of a bucket is linked to the bucket's least member, if whole sets confirm it, and components are formed;
2. only members of one bucket that lie in different components still need a comparison. Their signatures are compared in
   tiles (parts of a bucket met with parts). Members with a partner within six deviations of the resemblance meet again
   with their whole sets; a tile pair gives as many links as connect what is alike, not its pairs.

Components come from rounds of hooking and pointer doubling over stored tables (`simhash.components`).

Edge cases: NULL, empty and blank texts have no shingles: size 0, linked with nothing, each its own component. Equal texts
are one node, so rows that repeat an id or a text cost nothing. A row without an id links like any other but names no
component; a component of such rows only is named NULL. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, exact_ids, text_class
from .simhash import Shingles, components, forest

#: Words of a shingle, least resemblance as a fraction of integers, bands and places of a band.
SHINGLE, SHARE, WHOLE = 2, 80, 100
BANDS, PLACES = 60, 7
#: Places whose lowest bits are compared before sets are, and how many may differ: over six deviations at 0.8.
BITS, DIFFERING = 256, 57
#: Bucket members in one tile, elements of their sets; elements that one step of signatures handles at a time (memory only).
TILE, TILE_ELEMENTS, CHUNK = 2048, 1 << 20, 1 << 15
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_GOLDEN = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _offer(best: np.ndarray, elements: np.ndarray, owner: np.ndarray) -> None:
    """Lower the rows of `best` by the offers of elements; owner: the row of each element."""
    m = best.shape[1]
    flat = best.reshape(-1)
    missing = (best == _EMPTY).sum(axis=1)
    # The last level that can still lower a place of each row; unknown while a place is empty.
    last = np.where(missing > 0, m - 1, (best.max(axis=1) >> np.uint64(32)).astype(np.int64))
    places = np.empty((len(elements), m), np.uint16)
    places[:] = np.arange(m, dtype=np.uint16)
    active = np.arange(len(elements))
    for level in range(m):
        x = _mixed(elements[active] + np.uint64((level + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF))
        at = level + ((x >> np.uint64(32)) * np.uint64(m - level) >> np.uint64(32)).astype(np.int64)
        place = places[active, at]
        places[active, at] = places[active, level]
        spot = owner[active] * m + place
        new = np.unique(spot[flat[spot] == _EMPTY])
        np.minimum.at(flat, spot, np.uint64(level << 32) | (x & np.uint64(0xFFFFFFFF)))
        if len(new):
            filled = np.bincount(new // m, minlength=len(best))
            missing = missing - filled
            last = np.where((missing == 0) & (filled > 0), level, last)
        active = active[last[owner[active]] > level]
        if not len(active):
            break


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """SuperMinHash signatures (rows) of sets of distinct 64-bit hashes; the empty set's row is all ones."""
    out = np.full((len(sets), places), _EMPTY, np.uint64)
    order = sorted((i for i, s in enumerate(sets) if len(s)), key=lambda i: len(sets[i]))
    at = 0
    while at < len(order):
        end, total = at + 1, len(sets[order[at]])
        while end < len(order) and total + len(sets[order[end]]) <= CHUNK:
            total, end = total + len(sets[order[end]]), end + 1
        rows = order[at:end]
        best = np.full((len(rows), places), _EMPTY, np.uint64)
        elements = np.concatenate([sets[i] for i in rows])
        owner = np.repeat(np.arange(len(rows)), [len(sets[i]) for i in rows])
        for cut in range(0, len(elements), CHUNK):
            _offer(best, elements[cut:cut + CHUNK], owner[cut:cut + CHUNK])
        out[rows] = best
        at = end
    return out


def band_keys(signature: np.ndarray, bands: int, places: int) -> np.ndarray:
    """The bucket of each band of each signature."""
    parts = signature[:, :bands * places].reshape(len(signature), bands, places)
    keys = np.broadcast_to(_mixed(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_GOLDEN)), parts.shape[:2]).copy()
    for k in range(places):
        keys = _mixed(keys * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return keys.view(np.int64)


def described(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, places: int = PLACES) -> DataFrame:
    """A row per row of docs: doc_id, class, n (size of the set), keys (its buckets), names (32 bits of each key), places (8 bits
    of each place of the signature), bits (one of each, 64 a number)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles()
        for whole in batches:
            for cut in range(0, len(whole), 1000):
                b = whole.iloc[cut:cut + 1000]
                sets = [shingles.distinct(t, size) for t in b["text"]]
                made = signatures(sets, bands * places)
                bits = np.packbits((made[:, :BITS] & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                keys = band_keys(made, bands, places)
                yield pd.DataFrame({
                    "doc_id": b["doc_id"], "class": b["class"], "n": [len(s) for s in sets],
                    "keys": list(keys), "bits": list(bits), "names": [row.tobytes() for row in keys.astype(np.uint32)],
                    "places": [row.tobytes() for row in made.astype(np.uint8)]})

    rows = exact_ids(docs, text_class("text").alias("class"), F.coalesce("text", F.lit("")).alias("text"))
    made = rows.mapInPandas(run, "doc_id string, class binary, n long, keys array<long>, bits array<long>, names binary, places binary")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def _sized(a: str, b: str, share: int, whole: int) -> F.Column:
    """Sets of these sizes can have the resemblance: the union is no less than the larger, the intersection no more than the smaller."""
    return F.least(a, b) * whole >= F.greatest(a, b) * share


def _bits(a: str, b: str) -> F.Column:
    """Differing bits are few enough."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)), F.lit(0)) <= DIFFERING


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures' bits allow the resemblance."""
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("bits").alias(f"{x}_bits"))
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(_bits("a_bits", "b_bits")).select("a", "b")


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, set (bytes of its ascending hashes): one row per node (node, class, first_id)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles()
        for b in batches:
            for cut in range(0, len(b), 500):
                part = b.iloc[cut:cut + 500]
                yield pd.DataFrame({"node": part["node"], "set": [shingles.distinct(t, size).tobytes() for t in part["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_class("text").alias("class"), "text")
    met = rows.join(nodes, "class").filter(F.col("_id").eqNullSafe(F.col("first_id")))
    return met.select("node", "text").mapInPandas(run, "node long, set binary").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, share: int, whole: int) -> DataFrame:
    """The pairs whose whole sets have the resemblance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = np.zeros(len(b), bool)
            for k, (x, y) in enumerate(zip(b["x"], b["y"])):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[k] = whole * both >= share * (len(x) + len(y) - both)
            yield b.loc[good, ["a", "b"]]

    of = lambda node, name: sets.select(F.col("node").alias(node), F.col("set").alias(name))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").mapInPandas(run, "a long, b long")


def _tiles(batches: Iterator[pd.DataFrame], solve: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """`solve` on every tile pair of rows sorted by it; one that a batch cuts is carried into the next."""
    keys = ["key", "lo", "hi"]
    rest: pd.DataFrame | None = None
    for batch in batches:
        part = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(part):
            continue
        key = part[keys].to_numpy()
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        found = [solve(part.iloc[i:j]) for i, j in zip(starts, starts[1:])]
        if found:
            yield pd.concat(found, ignore_index=True)
        rest = part.iloc[starts[-1]:]
    if rest is not None and len(rest):
        yield solve(rest)


def _sides(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of the two tiles of a tile pair; twice all rows if a tile meets itself."""
    if part["lo"].iloc[0] == part["hi"].iloc[0]:
        return np.arange(len(part)), np.arange(len(part))
    side = part["side"].to_numpy()
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def _near(part: pd.DataFrame, share: int, whole: int) -> pd.DataFrame:
    """The rows of a tile pair that have a near row of another root: sizes and signatures allow the resemblance.

    Two rows that share buckets of several bands count in the first of them only.
    """
    n, root, band = part["n"].to_numpy(), part["root"].to_numpy(), int(part["band"].iloc[0])
    bits = np.stack(part["bits"].to_list()).view(np.uint64)
    places = np.frombuffer(b"".join(part["places"]), np.uint8).reshape(len(part), -1)
    names = np.frombuffer(b"".join(part["names"]), np.uint32).reshape(len(part), -1)[:, :band]
    share_ = share / whole
    least = int(places.shape[1] * share_ - 6 * (places.shape[1] * share_ * (1 - share_)) ** 0.5)
    left, right = _sides(part)
    flagged = np.zeros(len(part), bool)
    for at in range(0, len(left), 256):
        x = left[at:at + 256]
        far = np.zeros((len(x), len(right)), np.int16)
        for w in range(bits.shape[1]):
            far += np.bitwise_count(bits[x, w][:, None] ^ bits[right, w][None, :])
        smaller, larger = np.minimum(n[x][:, None], n[right][None, :]), np.maximum(n[x][:, None], n[right][None, :])
        i, j = np.nonzero((far <= DIFFERING) & (root[x][:, None] != root[right][None, :]) & (smaller * whole >= larger * share))
        i, j = x[i], right[j]
        for cut in range(0, len(i), 8192):
            p, q = i[cut:cut + 8192], j[cut:cut + 8192]
            good = ((places[p] == places[q]).sum(axis=1) >= least) & ~(names[p] == names[q]).any(axis=1)
            flagged[p[good]] = flagged[q[good]] = True
    return part.loc[flagged, ["key", "lo", "hi", "side", "node", "root"]]


def _exact(part: pd.DataFrame, share: int, whole: int) -> pd.DataFrame:
    """Links (a, b) of a tile pair's rows of different roots: as many as connect what whole sets confirm.

    Intersections are counted from the lists of rows that have each element.
    """
    node, root = part["node"].to_numpy(), part["root"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in part["set"]]
    size = np.array([len(x) for x in sets])
    left, right = _sides(part)
    held = np.concatenate([sets[j] for j in right])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], np.repeat(np.arange(len(right)), size[right])[order]
    heads, tails = [np.zeros(0, int)], [np.zeros(0, int)]
    for i in left:
        low, high = np.searchsorted(held, sets[i], "left"), np.searchsorted(held, sets[i], "right")
        both = np.zeros(len(right), np.int64)
        for cut in range(0, len(low), CHUNK):
            a, width = low[cut:cut + CHUNK], (high - low)[cut:cut + CHUNK]
            spots = np.repeat(a - np.cumsum(width) + width, width) + np.arange(width.sum())
            both += np.bincount(owner[spots], minlength=len(right))
        good = (whole * both >= share * (size[i] + size[right] - both)) & (root[i] != root[right])
        heads.append(np.full(int(good.sum()), i))
        tails.append(right[good])
    label = forest(np.concatenate(heads), np.concatenate(tails), len(part))
    at = np.flatnonzero(label != np.arange(len(part)))
    a, b = node[label[at]], node[at]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _unmet(shared: DataFrame, nodes: DataFrame, roots: DataFrame, sets: DataFrame, scratch: Scratch, share: int, whole: int, tile: int) -> DataFrame:
    """Links (a, b), a < b, between members (key, band, node, n) of one bucket whose roots differ, confirmed on whole sets."""
    members = shared.select("key", "band", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = scratch.put("members", members)
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(tile), F.sum("n") / F.lit(TILE_ELEMENTS))).cast("int").alias("parts")
    open_ = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), parts).filter("low <> high")
    rows = members.join(open_.select("key", "parts"), "key")
    # A tile meets itself and every other tile of its bucket.
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["key", "lo", "hi"]
    rows = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"),
                       "band", "node", "n", "root")
    signed = rows.join(nodes.select("node", "bits", "places", "names"), "node").repartition(*keys).sortWithinPartitions(*keys)
    flagged = signed.mapInPandas(lambda it: _tiles(it, lambda x: _near(x, share, whole)), "key long, lo int, hi int, side int, node long, root long")
    flagged = scratch.put("flagged", flagged)
    filled = flagged.join(sets, "node").repartition(*keys).sortWithinPartitions(*keys)
    return filled.mapInPandas(lambda it: _tiles(it, lambda x: _exact(x, share, whole)), "a long, b long").distinct()


def linked(docs: DataFrame, scratch: Scratch, size: int = SHINGLE, share: int = SHARE, whole: int = WHOLE, bands: int = BANDS,
           places: int = PLACES, tile: int = TILE, proposed: DataFrame | None = None) -> DataFrame:
    """class, n, first_id, root: one row per distinct text; texts of one root are connected by links of the resemblance.

    share / whole: the least resemblance. proposed: pairs of text classes (a, b) to be looked at besides.
    first_id: the least doc_id with the text.
    """
    made = described(docs, size, bands, places)
    nodes = made.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits"),
                                      F.first("names").alias("names"), F.first("places").alias("places"))
    nodes = scratch.put("nodes", nodes.withColumn("node", F.monotonically_increasing_id()))
    banded = nodes.filter("n > 0").select("node", F.col("n").cast("int").alias("n"), F.posexplode("keys").alias("band", "key"))
    leads = banded.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("count")).filter("count > 1")
    shared = banded.join(leads.select("key", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n")), "key")
    shared = scratch.put("shared", shared)
    stars = shared.filter(F.col("node") != F.col("lead")).filter(_sized("n", "lead_n", share, whole)).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    if proposed is not None:
        of = lambda x: nodes.filter("n > 0").select(F.col("class").alias(x), F.col("node").alias(f"{x}_node"))
        known = proposed.join(of("a"), "a").join(of("b"), "b")
        stars = stars.union(known.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))).filter("a <> b").distinct()
    stars = scratch.put("stars", _plausible(stars, nodes))
    named = shared.select("node").union(stars.select("a")).union(stars.select("b")).distinct()
    sets = scratch.put("sets", _sets(docs, nodes.select("node", "class", "first_id").join(named, "node"), size))
    links = scratch.put("links", _confirmed(stars, sets, share, whole))
    roots = components(links, scratch, "near")
    more = scratch.put("more", _unmet(shared, nodes, roots, sets, scratch, share, whole, tile))
    scratch.drop("shared", "members", "flagged", "sets", "stars")
    if not more.isEmpty():
        joined = roots.filter("node <> root").select(F.least("node", "root").alias("a"), F.greatest("node", "root").alias("b")).union(more)
        roots = components(joined.distinct(), scratch, "far")
    found = nodes.join(roots, "node", "left").select("class", "n", "first_id", F.coalesce("root", "node").alias("root"))
    found = scratch.put("found", found)
    scratch.drop("links", "more", "nodes")
    return found


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs; the parameters are those of `linked`."""
    scratch = Scratch(docs.sparkSession, "minhash")
    found = linked(docs, scratch, **how)
    least = found.filter("n > 0").groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = scratch.put("named", found.join(least, "root", "left").select("class", "n", "component_id"))
    scratch.drop("found")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_class("text").alias("class"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    out = rows.join(named, "class").select("doc_id", F.col("n").alias("n_shingles"), own)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def digest(docs: DataFrame) -> DataFrame:
    """The result of query op11_minhash."""
    return near_duplicates(docs)
