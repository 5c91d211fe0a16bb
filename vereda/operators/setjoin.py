"""Similarity joins over token sets, without comparing all pairs.

Two sets with Jaccard >= t must share a token within the first
|A| - ceil(t|A|) + 1 tokens of each, under any one global token order. Ordering
tokens from rare to common makes that prefix selective and keeps common tokens,
which would form huge groups, out of the join. The number of shared prefix
tokens and the position of the last one then bound the total overlap, which
drops nearly all remaining pairs before the full sets are read. Survivors are
verified on the full sets, so the result equals brute force (tokens travel as
64-bit fingerprints).

Sets that are only compared inside blocks move once, to their block, as the
texts they are made of; there the same filter works in memory. Blocks too large
for one task are compared part by part, the largest as sets without blocks are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import text as T

# Tokens that one task compares in memory, those that a row itself counts for, and meetings of tokens held at a time.
HELD_TOKENS, ROW_TOKENS, HELD_PRODUCTS = 1 << 21, 8, 1 << 19
# Parts of a block up to which its texts are moved once for each part of the other side; prefixes take less beyond.
MOST_PARTS = 32


def _ceil(x: Column) -> Column:
    # The small slack keeps a product such as 0.7 * 10 from rounding up to 8.
    return F.ceil(x - F.lit(1e-9)).cast("int")


def shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that is never broadcast: the optimizer takes exploded tokens for as small as the file they come from."""
    return df.hint("merge")


def text_id(c) -> Column:
    """128 bits that stand for a text wherever the text itself need not travel."""
    return F.substring(F.unhex(F.sha2(c, 256)), 1, 16)


def jaccard_join(left: DataFrame, right: DataFrame, threshold: float, *, strict: bool = False,
                 digits: int = 6, blocked: bool = False, once: bool = False,
                 of: Callable[[str], Column] | None = None) -> DataFrame:
    """(left_id, right_id, sim) for pairs at or above (`strict`: above) the threshold.

    Both inputs hold one row per distinct set: `id`, `tokens` (array<string>).
    With `blocked`, both also have `block`; only pairs sharing a block are
    compared, an id may appear under several blocks, and the result has the
    block too. With `once`, a join of a frame with itself gives each pair of
    different ids once, the smaller id on the left.

    With `of`, which needs `blocked`, sets are given as `text`, repeated or not:
    of("text") are the tokens, about one a character at most, and text_id("text")
    is the id. The texts move, their tokens are made where they are compared.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    if of is not None and not blocked:
        raise ValueError("texts are compared inside blocks only")
    if not blocked:
        return _prefix_join(left, right, threshold, strict, digits, False, once)

    given, size = ("tokens", F.size("tokens") + ROW_TOKENS) if of is None else ("text", F.length("text") + ROW_TOKENS)

    def sets(rows: DataFrame, *more: str) -> DataFrame:
        return rows if of is None else rows.select(text_id("text").alias("id"), "block", of("text").alias("tokens"), *more)

    def loads(sides: list[DataFrame]) -> DataFrame:
        """The blocks too large for one task, no more than the input has multiples of HELD_TOKENS, and their parts."""
        sized = [d.select("block", size.alias("n")) for d in sides]
        parts = F.ceil(F.sum("n") / HELD_TOKENS).alias("parts")
        return session.checkpoint(sized[0].unionByName(sized[1]).groupBy("block").agg(parts).filter("parts > 1"))

    sides = [d.filter(F.col("block").isNotNull() & F.col(given).isNotNull()) for d in (left, right)]
    large = loads(sides)
    if large.isEmpty():
        return _block_join(*sides, sets, ["block"], threshold, strict, digits, once)
    # Where much is asked, copies of a text count and move once.
    apart = [d.join(F.broadcast(large.select("block")), "block", "left_semi") for d in sides]
    apart = apart if of is None else [session.checkpoint(d.distinct()) for d in apart]
    parts = loads(apart)

    def tiles(rows: DataFrame, is_right: bool) -> DataFrame:
        """Each row in the tiles where its part of its side meets the parts of the other."""
        n, key = F.coalesce("parts", F.lit(1)), F.xxhash64("id" if of is None else "text")
        tile = F.transform(F.sequence(F.lit(0), n - 1), lambda other: (other * n + F.pmod(key, n)) if is_right else (F.pmod(key, n) * n + other))
        return rows.join(F.broadcast(parts), "block", "left").filter(n <= MOST_PARTS).select(*rows.columns, F.explode(tile).alias("tile"))

    rest = [d.join(F.broadcast(large.select("block")), "block", "left_anti").withColumn("tile", F.lit(0).cast("long")) for d in sides]
    found = _block_join(*(r.unionByName(tiles(d, i == 1)) for i, (r, d) in enumerate(zip(rest, apart))), sets, ["block", "tile"],
                        threshold, strict, digits, once)
    widest = parts.filter(F.col("parts") > MOST_PARTS)
    if widest.isEmpty():
        return found
    wide = [sets(d.join(F.broadcast(widest.select("block")), "block", "left_semi")) for d in apart]
    return found.unionByName(_prefix_join(*wide, threshold, strict, digits, True, once))


def _judged(met: DataFrame, threshold: float, strict: bool, digits: int, *more: str) -> DataFrame:
    """left_id, right_id, sim of pairs with the size i of their overlap and the sum n of their sizes."""
    raw = met.withColumn("raw", F.col("i") / (F.col("n") - F.col("i")))
    keep = F.col("raw") > threshold if strict else F.col("raw") >= threshold
    return raw.filter(keep).select("left_id", "right_id", *more, F.round("raw", digits).alias("sim"))


def _block_join(left: DataFrame, right: DataFrame, sets: Callable[..., DataFrame], keys: list[str], threshold: float,
                strict: bool, digits: int, once: bool) -> DataFrame:
    """Pairs that share the keys, `block` among them, each of about HELD_TOKENS tokens; a side may have an id more than once."""
    moved = left.withColumn("right", F.lit(False)).unionByName(right.withColumn("right", F.lit(True)))
    # Sorted before the tokens are made, so that neither the shuffle nor the sort holds them.
    rows = sets(moved.repartition(*keys).sortWithinPartitions(*keys), "right", *keys[1:]).select(
        *keys, "right", "id", F.transform("tokens", lambda x: F.xxhash64(x)).alias("codes"))
    kind, block = (rows.schema[c].dataType.simpleString() for c in ("id", "block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        side = table["right"].to_numpy()
        found = []
        for is_right in (False, True):
            part = table.filter(pa.array(side == is_right)).combine_chunks()
            if not part.num_rows:
                return
            # One row for each id.
            ids = part["id"].chunk(0)
            first = np.unique(ids.dictionary_encode().indices.to_numpy(), return_index=True)[1]
            codes = part["codes"].chunk(0).take(pa.array(first))
            found.append((ids.take(pa.array(first)), np.diff(codes.offsets.to_numpy()), codes.flatten().to_numpy()))
        (left_ids, left_sizes, left_codes), (right_ids, right_sizes, right_codes) = found
        for le, ri, i in overlaps(left_sizes, left_codes, right_sizes, right_codes, threshold):
            n = left_sizes[le] + right_sizes[ri]
            yield pa.RecordBatch.from_arrays(
                [left_ids.take(pa.array(le)), right_ids.take(pa.array(ri)), pa.repeat(table["block"][0], len(le)),
                 pa.array(i, pa.int32()), pa.array(n, pa.int32())], ["left_id", "right_id", "block", "i", "n"])

    met = rows.groupBy(*keys).applyInArrow(run, f"left_id {kind}, right_id {kind}, block {block}, i int, n int")
    if once:
        met = met.filter(F.col("left_id") < F.col("right_id"))
    return _judged(met, threshold, strict, digits, "block")


def _spread(many: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (many[0] of them), then those of starts[1] and so on."""
    return np.repeat(starts - np.cumsum(many) + many, many) + np.arange(many.sum())


def _pieces(many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most HELD_PRODUCTS in sum, or of one."""
    before, start = np.concatenate([[0], np.cumsum(many)]), 0
    while start < len(many):
        stop = max(start + 1, int(np.searchsorted(before, before[start] + HELD_PRODUCTS, "right")) - 1)
        yield start, stop
        start = stop


def overlaps(left_sizes: np.ndarray, left_codes: np.ndarray, right_sizes: np.ndarray, right_codes: np.ndarray,
             threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of sets (left, right, size of the overlap) that reach the threshold, in pieces of bounded size.

    The codes of a side are those of its sets one after the other, without repeats in a set.
    """
    def least(share: float, n: np.ndarray) -> np.ndarray:
        return np.ceil(share * n - 1e-9).astype(np.int64)

    _, code, many = np.unique(np.concatenate([left_codes, right_codes]), return_inverse=True, return_counts=True)
    rank = np.empty(len(many), np.int64)
    rank[np.argsort(many, kind="stable")] = np.arange(len(many))
    code, width = rank[code], len(many)

    def ordered(sizes: np.ndarray, codes: np.ndarray):
        """Each set's codes from rare to common, as set x width + code, their sets, their places, whether in the prefix."""
        of = np.repeat(np.arange(len(sizes)), sizes)
        key = np.sort(of * width + codes)
        place = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return key, of, place, place < (sizes - least(threshold, sizes) + 1)[of]

    key, of, place, early = ordered(left_sizes, code[:len(left_codes)])
    right_key, right_of, right_place, right_early = ordered(right_sizes, code[len(left_codes):])
    met = np.flatnonzero(right_early)
    met = met[np.argsort(right_key[met] % width, kind="stable")]
    first = np.searchsorted(right_key[met] % width, np.arange(width + 1))
    asked = np.flatnonzero(early)
    token = key[asked] % width
    many = first[token + 1] - first[token]
    bounds = np.searchsorted(of[asked], np.arange(len(left_sizes) + 1))
    before = np.concatenate([[0], np.cumsum(many)])[bounds]
    for start, stop in _pieces(np.diff(before)):
        part = slice(bounds[start], bounds[stop])
        to = met[_spread(many[part], first[token[part]])]
        le, at = np.repeat(of[asked[part]], many[part]), np.repeat(place[asked[part]], many[part])
        # Both sides are in the same order, so a pair's last meeting is at the last place of both.
        pair = le * len(right_sizes) + right_of[to]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        last = np.flatnonzero(np.append(pair[1:] != pair[:-1], True)[:len(pair)])
        shared = np.diff(last, prepend=-1)
        le, ri = pair[last] // len(right_sizes), pair[last] % len(right_sizes)
        nl, nr = left_sizes[le], right_sizes[ri]
        rest = np.minimum(nl - 1 - at[order[last]], nr - 1 - right_place[to[order[last]]])
        need = least(threshold / (1 + threshold), nl + nr)
        likely = np.flatnonzero((np.minimum(nl, nr) >= least(threshold, np.maximum(nl, nr))) & (shared + rest >= need))
        le, ri, nl, need = le[likely], ri[likely], nl[likely], need[likely]
        starts = (np.cumsum(left_sizes) - left_sizes)[le]
        for a, b in _pieces(nl):
            wanted = np.repeat(ri[a:b], nl[a:b]) * width + key[_spread(nl[a:b], starts[a:b])] % width
            spot = np.minimum(np.searchsorted(right_key, wanted), len(right_key) - 1)
            i = np.bincount(np.repeat(np.arange(b - a), nl[a:b])[right_key[spot] == wanted], minlength=b - a)
            good = np.flatnonzero(i >= need[a:b])
            if len(good):
                yield le[a + good], ri[a + good], i[good]


def _prefix_join(left: DataFrame, right: DataFrame, threshold: float, strict: bool, digits: int, blocked: bool,
                 once: bool) -> DataFrame:
    """jaccard_join by shuffled prefixes."""
    same = left is right
    keys = ["id", "block"] if blocked else ["id"]
    exploded = [d.select(*keys, F.explode("tokens").alias("token")) for d in ([left] if same else [left, right])]
    freq = exploded[0].select("token") if same else exploded[0].select("token").unionByName(exploded[1].select("token"))
    freq = freq.groupBy("token").agg(F.count("*").alias("n"))

    def encode(rows: DataFrame) -> DataFrame:
        """Fingerprints sorted from rare to common. Read twice, so stored once."""
        s = (rows.join(shuffled(freq), "token").groupBy(*keys)
             .agg(F.array_sort(F.collect_list(F.struct("n", F.xxhash64("token").alias("c")))).alias("s")))
        return session.checkpoint(s.select(*keys, F.transform("s", lambda x: x["c"]).alias("codes"), F.size("s").alias("size")))

    stored = [encode(e) for e in exploded]
    le, re = stored[0], stored[-1]

    def prefix(e: DataFrame, side: str) -> DataFrame:
        keep = F.col("size") - _ceil(F.lit(threshold) * F.col("size")) + 1
        return e.select(F.col("id").alias(f"{side}_id"), *(["block"] if blocked else []), F.col("size").alias(f"{side}_n"),
                        F.posexplode(F.slice("codes", F.lit(1), keep)).alias(f"{side}_pos", "code"))

    on = ["code", "block"] if blocked else ["code"]
    small, large = F.least("left_n", "right_n"), F.greatest("left_n", "right_n")
    met = prefix(le, "left").join(shuffled(prefix(re, "right")), on)
    if once:
        met = met.filter(F.col("left_id") < F.col("right_id"))
    met = met.filter(small >= _ceil(F.lit(threshold) * large))
    shared = met.groupBy("left_id", "right_id", "left_n", "right_n", *on[1:]).agg(
        F.count("*").alias("c"), F.max("left_pos").alias("lp"), F.max("right_pos").alias("rp"))
    most = F.col("c") + F.least(F.col("left_n") - 1 - F.col("lp"), F.col("right_n") - 1 - F.col("rp"))
    need = _ceil(F.lit(threshold / (1 + threshold)) * (F.col("left_n") + F.col("right_n")))
    pairs = shared.filter(most >= need).select("left_id", "right_id", *on[1:]).distinct()

    def full(e: DataFrame, side: str) -> DataFrame:
        one = e.select("id", "codes").dropDuplicates(["id"]) if blocked else e
        return one.select(F.col("id").alias(f"{side}_id"), F.col("codes").alias(f"{side}_set"))

    inter = F.size(F.array_intersect("left_set", "right_set"))
    checked = (pairs.join(shuffled(full(le, "left")), "left_id").join(shuffled(full(re, "right")), "right_id")
               .select("left_id", "right_id", *on[1:], inter.alias("i"), (F.size("left_set") + F.size("right_set")).alias("n")))
    return _judged(checked, threshold, strict, digits, *on[1:])


def contains_join(needles: DataFrame, haystack: DataFrame) -> DataFrame:
    """(left_id, right_id) where the right text contains the left text.

    Both: `id`, `text`, already normalised. Each needle is looked up through one
    gram of at most three letters, the rarest it has in the haystack.
    """
    def grams(c: Column, n: int) -> Column:
        last = F.length(c) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                                             lambda i: F.substring(c, i, F.lit(n)))
                      ).otherwise(F.array().cast("array<string>"))

    def own_grams(c: Column) -> Column:
        return F.when(F.length(c) >= 3, grams(c, 3)).when(F.length(c) == 2, grams(c, 2)).otherwise(grams(c, 1))

    text = F.col("text")
    # Grams carry ids only; texts are joined to the candidates.
    hay = haystack.filter(F.length("text") > 0).select(
        F.col("id").alias("right_id"), F.explode(F.array_distinct(F.concat(grams(text, 1), grams(text, 2), grams(text, 3)))).alias("gram"))
    freq = hay.groupBy("gram").agg(F.count("*").alias("n"))
    want = needles.filter(F.length("text") > 0).select(
        F.col("id").alias("left_id"), text.alias("needle"),
        F.explode(F.array_distinct(own_grams(text))).alias("gram"))
    rarest = (want.join(freq, "gram", "left").groupBy("left_id", "needle")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
              .filter(F.col("best.n") > 0)
              .select("left_id", "needle", F.col("best.gram").alias("gram")))
    texts = haystack.select(F.col("id").alias("right_id"), text.alias("hay"))
    return (rarest.join(hay, "gram").select("left_id", "needle", "right_id").join(texts, "right_id")
            .filter(F.contains("hay", "needle")).select("left_id", "right_id"))


def name_lookup(questions: DataFrame, names: DataFrame, threshold: float, k: int, *,
                with_substring: bool = False, strict: bool = False, digits: int = 6) -> DataFrame:
    """Top-k names per question by word-trigram similarity.

    questions and names: one row per distinct text, column `text`. With
    `with_substring` an unaccented substring match also qualifies.
    """
    # The distinct texts are read several times and far smaller than their tables.
    questions, names = session.checkpoint(questions), session.checkpoint(names)
    q = questions.select(F.col("text").alias("id"), T.word_trigrams(T.unaccent("text")).alias("tokens"))
    n = names.select(F.col("text").alias("id"), T.word_trigrams(T.unaccent("text")).alias("tokens"))
    pairs = jaccard_join(q, n, threshold, strict=strict, digits=digits)
    if with_substring:
        hits = contains_join(
            questions.select(F.col("text").alias("id"), T.normalize("text").alias("text")),
            names.select(F.col("text").alias("id"), T.normalize("text").alias("text")))
        missing = hits.join(pairs, ["left_id", "right_id"], "left_anti")
        extra = missing.select("left_id", "right_id", F.round(T.jaccard(
            T.word_trigrams("left_id"), T.word_trigrams("right_id")), digits).alias("sim"))
        pairs = pairs.unionByName(extra)
    return top_names(pairs, k)


def top_names(pairs: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window
    w = Window.partitionBy("left_id").orderBy(F.col("sim").desc(), F.col("right_id").asc())
    return (pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(F.col("left_id").alias("question"), F.col("right_id").alias("name"), "sim", "rank"))


def near_tie_preference(matches: DataFrame, preferred: Column, margin: float = 0.05) -> DataFrame:
    """One match per question: a preferred one within `margin` of the best, else the best.

    matches: question, name, sim (few per question, after a top-k).
    """
    best = matches.groupBy("question").agg(F.max("sim").alias("best"))
    near = (F.col("sim") >= F.col("best") - margin - 1e-12) & preferred
    ranked = matches.join(best, "question").withColumn(
        "pick", F.struct(F.when(near, 0).otherwise(1).alias("c"), (-F.col("sim")).alias("s"), F.col("name")))
    return (ranked.groupBy("question").agg(F.min("pick").alias("pick"))
            .select("question", F.col("pick.name").alias("name"), (-F.col("pick.s")).alias("sim"),
                    (F.col("pick.c") == 0).alias("preferred")))


def entity_lookup(questions: DataFrame, catalog: DataFrame, threshold: float, k: int) -> DataFrame:
    """Name search over several entities: top-k inside each entity, then overall.

    questions: `text`; catalog: distinct (`text`, `entity`). A name qualifies
    above the threshold or by containing the question.
    """
    from pyspark.sql import Window
    questions, catalog = session.checkpoint(questions), session.checkpoint(catalog)
    names = session.checkpoint(catalog.select("text").distinct())
    q = questions.select(F.col("text").alias("id"), T.word_trigrams(T.unaccent("text")).alias("tokens"))
    n = names.select(F.col("text").alias("id"), T.word_trigrams(T.unaccent("text")).alias("tokens"))
    pairs = jaccard_join(q, n, threshold, strict=True)
    hits = contains_join(questions.select(F.col("text").alias("id"), T.normalize("text").alias("text")),
                         names.select(F.col("text").alias("id"), T.normalize("text").alias("text")))
    extra = hits.join(pairs, ["left_id", "right_id"], "left_anti").select(
        "left_id", "right_id",
        F.round(T.jaccard(T.word_trigrams(T.unaccent("left_id")), T.word_trigrams(T.unaccent("right_id"))), 6).alias("sim"))
    found = (pairs.unionByName(extra).join(catalog.withColumnRenamed("text", "right_id"), "right_id")
             .select(F.col("left_id").alias("question"), "entity", F.col("right_id").alias("name"), "sim"))
    branch = Window.partitionBy("question", "entity").orderBy(F.col("sim").desc(), "name")
    overall = Window.partitionBy("question").orderBy(F.col("sim").desc(), "entity", "name")
    return (found.withColumn("b", F.row_number().over(branch)).filter(F.col("b") <= k)
            .withColumn("rank", F.row_number().over(overall)).filter(F.col("rank") <= k).drop("b"))
