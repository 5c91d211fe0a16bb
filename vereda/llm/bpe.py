"""Byte-level BPE by longest-match backtracking.

The vocabulary's byte strings are read as Latin-1, so that a byte is one character to the Aho-Corasick automaton. An
encoding takes the longest token at each place and steps back to the next shorter one where a token cannot follow its
predecessor. Two tokens can stand side by side exactly if merging the pair from scratch would leave that border alone;
this is decided from the tokens' own merges and remembered per pair. A place from which no encoding continues is marked,
so it is left for good and the work is linear in the length of the piece.

Texts are cut into pieces by the tokenizer's pattern; a piece that is itself a token is that token.

Edge cases: a NULL text encodes to no ids, as does the empty one. Text of any length is encoded whole. Rows are
independent, so repeated ids give repeated rows, and other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces whose encodings a worker remembers, token pairs, and a piece's longest length; all bound memory only.
CACHE, CACHED_PAIRS, CACHED_LENGTH = 100_000, 150_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: per line, a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The piece after all merges of rank under `below`, lowest first and leftmost first."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= below:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes = {i: token for token, i in ranks.items()}
        self.above = 1 + max(self.bytes, default=0)
        # How each token arises: the two tokens that its last merge joins. Tokens that no merge reaches are left out.
        self.halves: dict[int, tuple[int, int]] = {}
        reachable = set()
        automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = merged(token, ranks, rank)
                if len(parts) != 2 or any(p not in ranks for p in parts):
                    continue
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
            reachable.add(rank)
            automaton.add_word(token.decode("latin-1"), rank)
        automaton.make_automaton()
        self.automaton = automaton
        self.shorter = {i: self._shorter(self.bytes[i], reachable) for i in reachable}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _shorter(self, token: bytes, reachable: set[int]) -> int:
        """The longest proper prefix that is a token, or -1."""
        for n in range(len(token) - 1, 0, -1):
            if (i := self.ranks.get(token[:n], -1)) in reachable:
                return i
        return -1

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' bytes from scratch gives back just these two."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        """Undo both tokens' merges, latest first; the border breaks if the tokens now at it merge before that merge."""
        ranks, name, halves, limit = self.ranks, self.bytes, self.halves, self.above
        while True:
            if ranks.get(name[left] + name[right], limit) < limit:
                return False
            undo_left = left in halves and (left > right or right not in halves)
            if undo_left:
                limit, left = left, halves[left][1]
            elif right in halves:
                # The right token's merge stands left of nothing earlier: at equal rank the leftmost merge comes first.
                limit, right = right + 1, halves[right][0]
            else:
                return True

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one piece, given as Latin-1 characters of its bytes."""
        whole = self.ranks.get(text.encode("latin-1"))
        if whole is not None:
            return (whole,)
        n = len(text)
        longest = [-1] * n
        for end, rank in self.automaton.iter(text):
            start = end + 1 - len(self.bytes[rank])
            longest[start] = rank  # ends only grow, so the last match seen at a start is the longest
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        size, shorter = self.bytes, self.shorter
        while True:
            end = at + len(size[token])
            if not dead[end] and (not out or self._fits(out[-1], token)):
                out.append(token)
                if end == n:
                    return tuple(out)
                at, token = end, longest[end]
                continue
            token = shorter[token]
            while token < 0:  # nothing shorter here: this place cannot be an end
                dead[at] = 1
                token = out.pop()
                at -= len(size[token])
                token = shorter[token]

    def encode(self, text: str) -> list[int]:
        cache, ids = self.cache, []
        for found in self.find(text):
            known = cache.get(found)
            if known is None:
                known = self.piece(found.encode("utf-8", "surrogatepass").decode("latin-1"))
                if len(found) <= CACHED_LENGTH:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[found] = known
            ids.extend(known)
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=1)
def _codec(packed: bytes, pattern: str) -> Codec:
    lines = (line.split() for line in packed.splitlines())
    return Codec({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)


def _vocabulary(docs: DataFrame, path: str):
    """The rank file, read once on the driver and broadcast: a fixed file of under a megabyte, checked."""
    with open(path, "rb") as f:
        packed = f.read()
    if len(packed) > 64 << 20:
        raise ValueError("the rank file is too large to broadcast")
    return docs.sparkSession.sparkContext.broadcast(packed)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids (array<int>)."""
    shared = _vocabulary(docs, path)

    def run(batch: pd.Series) -> pd.Series:
        codec = _codec(shared.value, pattern)
        return pd.Series([np.array(codec.encode(t) if isinstance(t, str) else [], np.int32) for t in batch])

    return docs.withColumn(ids, F.pandas_udf(run, "array<int>")(F.col(text)))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """docs with the text of a column of ids; ids whose bytes are no UTF-8 raise, NULL ids give the empty text."""
    shared = _vocabulary(docs, path)

    def run(batch: pd.Series) -> pd.Series:
        codec = _codec(shared.value, pattern)
        return pd.Series([codec.decode(x).decode("utf-8") if x is not None else "" for x in batch])

    return docs.withColumn(text, F.pandas_udf(run, "string")(F.col(ids)))


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The result of query op5_bpe: encodes, decodes and sums up each text in one pass."""
    shared = _vocabulary(docs, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared.value, pattern)
        for b in batches:
            counts, sums, back = [], [], []
            for t in b["text"]:
                ids = codec.encode(t) if isinstance(t, str) else []
                counts.append(len(ids))
                sums.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": counts, "ids_sha256": sums, "decoded_sha256": back})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of each text, for training; each encoding is decoded again and must match."""
    shared = _vocabulary(docs, path)

    def run(texts: pd.Series) -> pd.Series:
        codec, out = _codec(shared.value, pattern), []
        for t in texts:
            ids = codec.encode(t) if isinstance(t, str) else []
            if codec.decode(ids) != (t if isinstance(t, str) else "").encode("utf-8", "surrogatepass"):
                raise ValueError("a text did not survive encoding")
            out.append(np.array(ids, np.int32))
        return pd.Series(out)

    rows = docs.select("doc_id", "source", F.pandas_udf(run, "array<int>")(F.col("text")).alias("ids"))
    return rows.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")
