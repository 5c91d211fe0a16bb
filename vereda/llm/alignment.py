"""Alignment of two tokenizers' tokens by merge-path partitioning.

Each tokenizer cuts a document's bytes at the ends of its tokens. Merging the two ascending lists of ends shows where both
end: these places cut the document into groups, and the tokens that end there are links. The lists of a batch of documents
are merged as one: diagonals of the merge grid cut it into pieces of equal work, a binary search on each diagonal finds
where the merge path crosses it, and pieces are merged independently. A piece emits the common ends that lie in it (equal
ends are never parted); groups that run over a border are stitched by numbering them over all pieces.

Counts over the corpus take two passes. The first stores, per block of documents, the linked id pairs as indexes into the
block's own list of distinct pairs, and that list with its counts. Pairs are counted and compared from the lists: a pair
that every document has is one row a block, not a document. The answers go back to their blocks as one packed list each,
which the second pass joins with the block's documents.

Edge cases: NULL and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens: zeros and an
empty digest. Special tokens' strings inside texts are plain text. Texts of any length are encoded whole. Rows are
independent; repeated rows count each time; a NULL id is returned. Other columns are ignored; an empty table gives an empty
result. Token ids are below 2**31.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, exact_ids

#: Ends that one piece merges; characters encoded at a time, links and documents of a block (memory and exchange only).
PIECE, BATCH_CHARS, BLOCK_LINKS, BLOCK_ROWS = 4096, 1 << 19, 1 << 20, 4000
#: Characters above which texts take the slower of two encoders that agree.
LONG_TEXT = 100_000

Encoder = Callable[[list[str]], list[list[int]]]
#: A tokenizer: how a list of texts is encoded, and the bytes of every token.
Side = tuple[Encoder, list[bytes]]


def byte_level(path: str, pattern: str | None = None) -> Side:
    """A byte-level vocabulary file of the `tokenizers` library.

    pattern: the expression that the file's pre-tokenizer splits by. With it, and if the file's merges stand in the order of
    the ids they make, ids serve as ranks and `tiktoken` encodes, to the same ids in a seventh of the time. Its expression
    engine cannot look back over very long runs of spaces, so long texts go to the `tokenizers` library all the same.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer, pre_tokenizers

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    # A byte-level character stands for one byte: printable Latin-1 characters for themselves, the rest, in order, for 256 on.
    alphabet = set(pre_tokenizers.ByteLevel.alphabet())
    own = [b for b in range(256) if chr(b) in alphabet]
    rest = [b for b in range(256) if chr(b) not in alphabet]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocabulary, special = made.get_vocab(), {t.content for t in made.get_added_tokens_decoder().values()}
    tokens = [b""] * (1 + max(vocabulary.values()))
    for piece, i in vocabulary.items():
        tokens[i] = piece.encode() if piece in special else bytes(byte[c] for c in piece)
    with open(path, encoding="utf-8") as file:
        merges = json.load(file)["model"]["merges"]
    results = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    fast = None
    if pattern is not None and results == sorted(set(results)):
        ranks = {tokens[i]: i for piece, i in vocabulary.items() if piece not in special}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(texts: list[str]) -> list[list[int]]:
        slow = [t for t in texts if fast is None or len(t) > LONG_TEXT]
        whole = iter([x.ids for x in made.encode_batch_fast(slow, add_special_tokens=False)])
        return [next(whole) if fast is None or len(t) > LONG_TEXT else fast(t) for t in texts]

    return encode, tokens


def pieces(path: str) -> Side:
    """A model file of the `sentencepiece` library with byte fallback."""
    from sentencepiece import SentencePieceProcessor

    made = SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(made.get_piece_size()):
        name = made.id_to_piece(i)
        tokens.append(bytes([int(name[3:5], 16)]) if made.is_byte(i) else name.replace("▁", " ").encode())
    return lambda texts: made.encode(texts, num_threads=1), tokens


def diagonal_splits(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two ascending lists crosses every `piece`-th diagonal: how much of a and b lies before.

    Of equal values a's comes first. A crossing between two equal values moves past b's, so that no piece parts them.
    """
    n, m = len(a), len(b)
    diagonals = np.r_[np.arange(0, n + m, piece), n + m]
    low, high = np.maximum(0, diagonals - m), np.minimum(diagonals, n)
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        first = np.zeros(len(low), bool)
        first[open_] = a[middle[open_]] <= b[diagonals[open_] - middle[open_] - 1]
        low, high = np.where(open_ & first, middle + 1, low), np.where(open_ & ~first, middle, high)
    i, j = low, diagonals - low
    parted = (i > 0) & (j < m)
    parted[parted] = a[i[parted] - 1] == b[j[parted]]
    return i, j + parted


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with a[i] = b[j] of two strictly ascending lists, merged piece by piece."""
    i, j = diagonal_splits(a, b, piece)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(len(i) - 1):
        x, y = a[i[k]:i[k + 1]], b[j[k]:j[k + 1]]
        both = np.concatenate([x, y])
        by = np.argsort(both, kind="stable")
        twice = np.flatnonzero(both[by[1:]] == both[by[:-1]])
        left.append(i[k] + by[twice])
        right.append(j[k] + by[twice + 1] - len(x))
    return np.concatenate(left), np.concatenate(right)


class Aligner:
    """Encodes and aligns lists of texts."""

    def __init__(self, a: Side, b: Side):
        self.sides = (a, b)
        self.sizes = [np.array([len(t) for t in tokens], np.int64) for _, tokens in self.sides]

    def encoded(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by each side; none where a side does not give the text back."""
        full = [i for i, t in enumerate(texts) if t]
        wanted = [f" {texts[i]}".encode("utf-8", "surrogatepass") for i in full]
        out = tuple([np.zeros(0, np.int64)] * len(texts) for _ in self.sides)
        (encode_a, tokens_a), (encode_b, tokens_b) = self.sides
        ids_a, ids_b = encode_a([f" {texts[i]}" for i in full]), encode_b([texts[i] for i in full])
        for i, want, x, y in zip(full, wanted, ids_a, ids_b):
            if b"".join(map(tokens_a.__getitem__, x)) == want == b"".join(map(tokens_b.__getitem__, y)):
                out[0][i], out[1][i] = np.array(x, np.int64), np.array(y, np.int64)
        return out

    def aligned(self, texts: list[str | None]) -> list[tuple]:
        """Per text: ids a, ids b, places in a and in b of the links' tokens, places in a and in b where groups end."""
        ids = self.encoded(texts)
        ends, offsets = [], []
        for side, size in zip(ids, self.sizes):
            flat = np.concatenate([*side, np.zeros(0, np.int64)])
            # Documents stand one place apart, so that their ends never meet.
            ends.append(np.cumsum(size[flat]) + np.repeat(np.arange(len(texts)), [len(x) for x in side]))
            offsets.append(np.cumsum([0, *map(len, side)]))
        # Tokens without bytes share the end of the one before: only the last of equal ends cuts, all of them are linked.
        unique = [np.flatnonzero(np.r_[e[1:] != e[:-1], np.ones(min(1, len(e)), bool)]) for e in ends]
        i, j = common_ends(ends[0][unique[0]], ends[1][unique[1]])
        cut_a, cut_b = unique[0][i], unique[1][j]
        first = [np.r_[-1, u[:-1]] + 1 for u in unique]
        many = [cut - f[at] + 1 for cut, f, at in zip((cut_a, cut_b), first, (i, j))]
        if len(i) and (many[0].max() > 1 or many[1].max() > 1):
            pairs = [(x, y) for p, q, r, s in zip(cut_a, many[0], cut_b, many[1]) for x in range(p - q + 1, p + 1) for y in range(r - s + 1, r + 1)]
            link_a, link_b = np.array(pairs, np.int64).T
        else:
            link_a, link_b = cut_a, cut_b
        out = []
        spans = [np.searchsorted(x, o) for x, o in ((link_a, offsets[0]), (link_b, offsets[1]), (cut_a, offsets[0]), (cut_b, offsets[1]))]
        for k in range(len(texts)):
            a0, b0 = offsets[0][k], offsets[1][k]
            la, lb, ca, cb = (x[s[k]:s[k + 1]] - o for x, s, o in zip((link_a, link_b, cut_a, cut_b), spans, (a0, b0, a0, b0)))
            out.append((ids[0][k], ids[1][k], la, lb, ca, cb))
        return out


@lru_cache(maxsize=2)
def _words(sizes: tuple[int, int]) -> list[str]:
    """Every id of both sides with the mark after it: inside its group, or last of its side."""
    return [f"{i}{mark}" for size, marks in zip(sizes, (",|", ",;")) for i in range(size) for mark in marks]


def groups_text(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, sizes: tuple[int, int]) -> str:
    """The groups as `a1,a2|b1;a3|b2,b3`: each group's ids of a, then of b."""
    if not len(cut_a):
        return ""
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[cut_a], last_b[cut_b] = 1, 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    spot_a = np.arange(len(a)) + np.r_[0, cut_b + 1][group_a]
    spot_b = np.arange(len(b)) + (cut_a + 1)[group_b]
    code = np.empty(len(a) + len(b), np.int64)
    code[spot_a], code[spot_b] = a * 2 + last_a, b * 2 + last_b + 2 * sizes[0]
    return "".join(map(_words(sizes).__getitem__, code.tolist()))[:-1]


def _parts(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Slices of a batch of at most BATCH_CHARS characters, or of one text."""
    size = b["text"].str.len().fillna(0).to_numpy(np.int64)
    start, held = 0, 0
    for k, n in enumerate(size):
        if k > start and held + n > BATCH_CHARS:
            yield b.iloc[start:k]
            start, held = k, 0
        held += n
    if start < len(b):
        yield b.iloc[start:]


def aligned(docs: DataFrame, a: Callable[[], Side], b: Callable[[], Side]) -> DataFrame:
    """doc_id, a_ids, b_ids, a_ends, b_ends: ids of both sides, and per group how many tokens of each lie up to its end.

    a, b: functions that open the tokenizers, called on the executors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(a(), b())
        for whole in batches:
            for part in _parts(whole):
                found = aligner.aligned([t if isinstance(t, str) else None for t in part["text"]])
                yield pd.DataFrame({
                    "doc_id": part["doc_id"], "a_ids": [x[0] for x in found], "b_ids": [x[1] for x in found],
                    "a_ends": [x[4] + 1 for x in found], "b_ends": [x[5] + 1 for x in found]})

    made = exact_ids(docs, "text").mapInPandas(run, "doc_id string, a_ids array<long>, b_ids array<long>, a_ends array<long>, b_ends array<long>")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


_FOUND = "block string, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def _first_pass(docs: DataFrame, a: Callable[[], Side], b: Callable[[], Side]) -> DataFrame:
    """Rows of documents (links: indexes into the block's pairs) and, per block, one row with its pairs and their counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(a(), b())
        sizes = tuple(len(s) for s in aligner.sizes)
        held: list[tuple] = []
        links = 0

        def block() -> pd.DataFrame:
            name = uuid.uuid4().hex
            codes = np.concatenate([c for *_, c in held])
            pairs, index, counts = np.unique(codes, return_inverse=True, return_counts=True)
            cuts = np.cumsum([len(c) for *_, c in held])[:-1]
            rows = [(name, *row[:-1], part.astype(np.int32).tobytes(), None, None) for row, part in zip(held, np.split(index, cuts))]
            rows.append((name, None, None, None, None, None, None, None, pairs.tobytes(), counts.astype(np.int64).tobytes()))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")] + ["pairs", "counts"])
            for c in ("n_a", "n_b", "n_groups", "n_links"):
                out[c] = pd.array(out[c].tolist(), dtype="Int64")
            return out

        for whole in batches:
            for part in _parts(whole):
                texts = [t if isinstance(t, str) else None for t in part["text"]]
                for doc_id, (x, y, la, lb, ca, cb) in zip(part["doc_id"], aligner.aligned(texts)):
                    listed = groups_text(x, y, ca, cb, sizes)
                    sha = hashlib.sha256(listed.encode()).hexdigest() if listed else ""
                    held.append((doc_id, len(x), len(y), len(ca), len(la), sha, x[la] << 32 | y[lb]))
                    links += len(la)
                    if links >= BLOCK_LINKS or len(held) >= BLOCK_ROWS:
                        yield block()
                        held, links = [], 0
        if held:
            yield block()

    return exact_ids(docs, "text").mapInPandas(run, f"{_FOUND}, pairs binary, counts binary")


def _unpacked(blocks: DataFrame) -> DataFrame:
    """block, at, pair, n: a row per distinct pair of a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, pairs, counts in zip(b["block"], b["pairs"], b["counts"]):
                pair = np.frombuffer(pairs, np.int64)
                yield pd.DataFrame({"block": name, "at": np.arange(len(pair), dtype=np.int32), "pair": pair, "n": np.frombuffer(counts, np.int64)})

    return blocks.select("block", "pairs", "counts").mapInPandas(run, "block string, at int, pair long, n long")


def counted(docs: DataFrame, a: Callable[[], Side], b: Callable[[], Side]) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of docs.

    A pair's count: how many links of the corpus hold it. n_best: links whose pair no other pair of the same b exceeds.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    stored = scratch.put("aligned", _first_pass(docs, a, b))
    asked = scratch.put("asked", _unpacked(stored.filter("pairs IS NOT NULL")))
    total = scratch.put("pairs", asked.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    best = total.groupBy("b").agg(F.max("count").alias("best"))
    judged = total.join(best, "b").select("pair", "count", (F.col("count") == F.col("best")).alias("top"))
    answers = asked.select("block", "at", "pair").join(judged, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "count", "top"))).alias("got"))
    answers = answers.select("block", F.col("got.count").alias("count"), F.col("got.top").alias("top"))

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        count = np.asarray(right["count"].iloc[0], np.int64) if len(right) else np.zeros(0, np.int64)
        top = np.asarray(right["top"].iloc[0], bool) if len(right) else np.zeros(0, bool)
        index = [np.frombuffer(x, np.int32) for x in left["links"]]
        out = left.drop(columns=["block", "links"])
        out["n_best"], out["count_sum"] = [int(top[x].sum()) for x in index], [int(count[x].sum()) for x in index]
        return out[[c.split()[0] for c in columns.split(", ")]]

    columns = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    rows = stored.filter("pairs IS NULL").drop("pairs", "counts")
    found = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, columns)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
