"""Substring dedup by recompression: words repeated from an earlier document in windows of 13 are removed.

Recompression replaces, round by round, maximal runs of one symbol and then pairs of neighbouring symbols by new ones.
A symbol's name is a hash of what it stands for, so names agree over all documents without a dictionary. Which pairs
merge depends on the two names alone (one drawn to the left, the other to the right half), so equal substrings get equal
symbols except at their ends: each symbol carries its context, the words that settle it, and every copy of these words
holds the same symbol. Each window picks the symbol of the highest round whose context it contains, least hash first;
equal windows pick alike. Documents thus share a window only where they share its symbol.

1. Equal texts are one class, named by 128 bits, standing at its least id.
2. The distinct texts are stored in batches. Each batch asks, in packed arrays, which of its symbols others have too; the
   answer is one bit per symbol.
3. Windows under shared symbols are verified by 96-bit hashes of their 13 words: a batch asks for each distinct one,
   with its least id, whether a smaller id has it; the answer is again one bit.
4. Words covered by such windows go. Texts without shared symbols are done after step 2.

A batch asks once per symbol or window however many of its documents have it, so a passage that a third of all documents
share costs one entry per batch. Windows are judged on the input.

Edge cases: NULL and blank texts have no words. Texts of fewer than 13 words are kept whole. NULL ids come last: they
never count as smaller, and a copy of any document with an id goes. Rows of one id and text are alike. Other columns are
kept by `deduplicated` whatever their names, and ignored by `digest`. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, Scratch, text_class

WINDOW = 13
ROUNDS = 2
#: Bytes of text in a batch, and entries a task answers at once: they bound memory, not results.
BATCH_BYTES, ANSWERED = 2 << 20, 600_000
#: Order value of a NULL id.
LAST = np.iinfo(np.int64).max

_U = np.uint64
_BASE, _BASE2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
#: Words whose hashes a task remembers.
_KNOWN = 150_000


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finaliser of a public 64-bit hash)."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Names(dict):
    """64-bit names of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _KNOWN:
            self.clear()
        self[word] = name = xxhash.xxh3_64_intdigest(word)
        return name


class Text:
    """The words of some documents in one row, and their polynomial hashes."""

    def __init__(self, texts: list[bytes], names: _Names):
        self.words = [WORD_BYTES.findall(t) for t in texts]
        self.ends = np.cumsum([0, *map(len, self.words)])
        n = int(self.ends[-1])
        self.name = np.fromiter((names[w] for doc in self.words for w in doc), _U, n)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.ends))

    def hashes(self, start: np.ndarray, end: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
        """Hashes of the words in [start, end)."""
        n = len(self.name)
        with np.errstate(over="ignore"):
            # Running sums of name_i B^i: the difference over [s, e) is B^s times the hash; an odd B has an inverse.
            sums = np.concatenate([np.zeros(1, _U), np.add.accumulate(_mix(self.name ^ base) * _powers(base, n))])
            inverse = _powers(_U(pow(int(base), -1, 1 << 64)), n + 1)
            return _mix((sums[end] - sums[start]) * inverse[start] ^ (end - start).astype(_U))

    def symbols(self, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per round, the contexts [start, end) of all symbols; those that a document's end settles are left out."""
        n = len(self.name)
        name, doc = self.name, self.doc
        low, high = np.arange(n), np.arange(1, n + 1)
        out = [(low, high)]
        for r in range(rounds):
            # Runs: every context takes in the two symbols next to the run, which settle where it ends.
            first = np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])][:len(name)]
            head = np.flatnonzero(first)
            count = np.diff(np.r_[head, len(name)])
            tail = head + count - 1
            with np.errstate(over="ignore"):
                run = np.where(count > 1, _mix(name[head] * _BASE2 + count.astype(_U)), name[head])
            doc_run = doc[head]
            before = np.r_[False, doc_run[1:] == doc_run[:-1]][:len(head)]
            after = np.r_[doc_run[1:] == doc_run[:-1], False][:len(head)]
            low2 = np.where(before, low[head - 1], -LAST // 4)
            high2 = np.where(after, high[np.minimum(tail + 1, len(high) - 1)], LAST // 4)
            name, doc, low, high = run, doc_run, low2, high2
            # Pairs: a left and a right one merge; else a left one is settled by its successor, a right one by its predecessor.
            right = (_mix(name + _U(r + 1)) & _U(1)).astype(bool)
            same = np.r_[doc[1:] == doc[:-1], False][:len(name)]
            pair = same & ~right & np.r_[right[1:], False][:len(name)]
            follows = np.r_[False, pair[:-1]][:len(name)]
            nxt_high = np.where(same, np.r_[high[1:], 0][:len(name)], LAST // 4)
            prev = np.r_[False, same[:-1]][:len(name)]
            prv_low = np.where(prev, np.r_[0, low[:-1]][:len(name)], -LAST // 4)
            nxt_name = np.r_[name[1:], name[:1]][:len(name)]
            with np.errstate(over="ignore"):
                merged = _mix(name * _BASE + _mix(nxt_name))
            new_low = np.where(~pair & right, np.minimum(low, prv_low), low)
            new_high = np.where(pair | ~right, np.maximum(high, nxt_high), high)
            keep = ~follows
            name, doc = np.where(pair, merged, name)[keep], doc[keep]
            low, high = new_low[keep], new_high[keep]
            good = (low >= 0) & (high - low <= WINDOW) & (high - low > 0)
            out.append((low[good], high[good]))
        return out

    def picked(self, rounds: int = ROUNDS) -> np.ndarray:
        """For the window at each word, the key of the symbol it picks; 0 where no window fits the document."""
        n = len(self.name)
        key = np.zeros(n, _U)
        if not n:
            return key
        starts = np.arange(n)
        whole = starts + WINDOW <= self.ends[1:][self.doc]
        open_ = whole.copy()
        for r, (low, high) in reversed(list(enumerate(self.symbols(rounds)))):
            if not open_.any():
                break
            with np.errstate(over="ignore"):
                own = _mix(self.hashes(low, high) + _U(r)) | _U(1)
            best = np.full(n, np.iinfo(_U).max, _U)
            for d in range(WINDOW):
                at = low - d
                fits = (at >= 0) & (high <= at + WINDOW)
                at, value = at[fits], own[fits]
                np.minimum.at(best, at, value)
            found = open_ & (best != np.iinfo(_U).max)
            key[found] = best[found]
            open_ &= ~found
        return key


def _pack(texts: list[bytes]) -> tuple[bytes, bytes]:
    import zstandard

    ends = np.cumsum([0, *map(len, texts)])
    return ends.tobytes(), zstandard.ZstdCompressor(level=3).compress(b"".join(texts))


def _unpack(ends: bytes, data: bytes) -> list[bytes]:
    import zstandard

    whole, at = zstandard.ZstdDecompressor().decompress(data), np.frombuffer(ends, np.int64).tolist()
    return [whole[a:b] for a, b in zip(at, at[1:])]


_BATCH = "uid string, classes binary, reps binary, ends binary, data binary, size long"
_ASK = "uid string, bucket int, a binary, b binary, c binary"
_PART = f"kind string, {_ASK}, d binary, e binary"
_RESULT = "class binary, rep long, n_words long, n_removed long, kept_sha256 string, kept string"


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        data = [press.compress(x) for x in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("class"), b.column("rep"), pa.array(data, pa.binary())], ["class", "rep", "data"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct texts as batches of some megabytes; a batch is named by its first class."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    held: list[tuple[bytes, int, bytes]] = []
    size = 0

    def row() -> pa.RecordBatch:
        ends, data = _pack([x[2] for x in held])
        reps = np.array([x[1] for x in held], np.int64)
        one = {"uid": held[0][0].hex(), "classes": b"".join(x[0] for x in held), "reps": reps.tobytes(), "ends": ends, "data": data, "size": size}
        return pa.RecordBatch.from_pylist([one], schema=pa.schema([
            ("uid", pa.string()), ("classes", pa.binary()), ("reps", pa.binary()), ("ends", pa.binary()), ("data", pa.binary()), ("size", pa.int64())]))

    for b in batches:
        for name, rep, data in zip(b.column("class").to_pylist(), b.column("rep").to_pylist(), b.column("data").to_pylist()):
            text = press.decompress(data)
            held.append((name, LAST if rep is None else rep, text))
            size += len(text)
            if size >= BATCH_BYTES:
                yield row()
                held, size = [], 0
    if held:
        yield row()


def _split(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending 64-bit keys, dealt by their high bits."""
    number = ((keys >> _U(32)) * _U(buckets)) >> _U(32)
    cut = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(keys) else np.zeros(0, int)
    return [(int(number[a]), int(a), int(b)) for a, b in zip(cut, [*cut[1:], len(keys)])]


def _keys(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, each window's place among them (-1: no window), and whether two of the documents have the key."""
    picked = text.picked()
    at = np.flatnonzero(picked)
    keys, place = np.unique(picked[at], return_inverse=True)
    least, most = np.full(len(keys), LAST), np.full(len(keys), -1)
    np.minimum.at(least, place, text.doc[at])
    np.maximum.at(most, place, text.doc[at])
    of = np.full(len(picked), -1)
    of[at] = place
    return keys, of, most > least


def _windows(text: Text, at: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows among those at the places: hash, further hash bits, least id, and each place's number."""
    h = text.hashes(at, at + WINDOW)
    g = (text.hashes(at, at + WINDOW, _BASE2) >> _U(32)).astype(np.uint32)
    rep = reps[text.doc[at]]
    order = np.lexsort((rep, g, h))
    h, g, rep = h[order], g[order], rep[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])][:len(h)]
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(first) - 1
    return h[first], g[first], rep[first], number


def _bits(asked: list[tuple[int, int, int]], answers, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    told = {x["bucket"]: x["bits"] for x in answers if x is not None} if answers is not None else {}
    for bucket, a, b in asked:
        out[a:b] = np.unpackbits(np.frombuffer(told[bucket], np.uint8), count=b - a).astype(bool)
    return out


def _rows(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
    fields = [(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]
    return pa.RecordBatch.from_pylist([{f: r.get(f) for f, _ in fields} for r in rows], schema=pa.schema(fields))


def _result(name: bytes, rep: int, words: list[bytes], gone: np.ndarray | None, with_text: bool) -> dict:
    kept = words if gone is None else [w for w, g in zip(words, gone) if not g]
    n, text = len(words) - len(kept), b" ".join(kept)
    return {"class": name, "rep": None if rep == LAST else rep, "n_words": len(words), "n_removed": n,
            "kept_sha256": hashlib.sha256(text).hexdigest(), "kept": text.decode("utf-8", "surrogatepass") if with_text and n else None}


def _answer(ask: DataFrame, run) -> DataFrame:
    """uid, answers: the bits of each batch's questions, by bucket."""
    told = ask.groupBy("bucket").applyInPandas(run, "uid string, bucket int, bits binary")
    return told.groupBy("uid").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))


def _shared(part: pd.DataFrame) -> pd.DataFrame:
    """Which symbols occur in two batches."""
    each = [np.frombuffer(x, np.uint32) for x in part["a"]]
    _, place, n = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    bits = np.split(n[place] > 1, np.cumsum([len(x) for x in each])[:-1])
    return pd.DataFrame({"uid": part["uid"], "bucket": part["bucket"], "bits": [np.packbits(x).tobytes() for x in bits]})


def _earlier(part: pd.DataFrame) -> pd.DataFrame:
    """Which windows a smaller id has."""
    each = [np.frombuffer(x, _U) for x in part["a"]]
    h, g = np.concatenate(each), np.concatenate([np.frombuffer(x, np.uint32) for x in part["b"]])
    rep = np.concatenate([np.frombuffer(x, np.int64) for x in part["c"]])
    order = np.lexsort((rep, g, h))
    first = np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]
    least = np.empty(len(h), np.int64)
    least[order] = rep[order][np.flatnonzero(first)[np.cumsum(first) - 1]]
    bits = np.split(least < rep, np.cumsum([len(x) for x in each])[:-1])
    return pd.DataFrame({"uid": part["uid"], "bucket": part["bucket"], "bits": [np.packbits(x).tobytes() for x in bits]})


def classes(docs: DataFrame, scratch: Scratch, with_text: bool = False) -> DataFrame:
    """class, rep, n_words, n_removed, kept_sha256, kept: for each distinct text, the result of its least id.

    kept is the remaining text where words were removed, if asked for, else NULL.
    """
    texts = docs.select(text_class("text").alias("class"), F.col("doc_id").cast("long").alias("rep"), F.coalesce("text", F.lit("")).alias("text"))
    packed = texts.mapInArrow(_squeezed, "class binary, rep long, data binary")
    distinct = packed.groupBy("class").agg(F.min("rep").alias("rep"), F.min("data").alias("data"))
    stored = scratch.put("batches", distinct.mapInArrow(_gathered, _BATCH))
    size = stored.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, math.ceil(size / 20 / ANSWERED))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names()
        for b in batches:
            for row in b.to_pylist():
                keys, _, _ = _keys(Text(_unpack(row["ends"], row["data"]), names))
                low = keys.astype(np.uint32)
                yield _rows(_ASK, [{"uid": row["uid"], "bucket": n, "a": low[a:z].tobytes()} for n, a, z in _split(keys, buckets)])

    told = _answer(stored.mapInArrow(ask, _ASK), _shared)
    told = scratch.put("shared", told)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names()
        for b in batches:
            for row in b.to_pylist():
                raw, reps = _unpack(row["ends"], row["data"]), np.frombuffer(row["reps"], np.int64)
                own = [row["classes"][i:i + 16] for i in range(0, len(row["classes"]), 16)]
                text = Text(raw, names)
                keys, of, twice = _keys(text)
                shared = twice | _bits(_split(keys, buckets), row["answers"], len(keys))
                at = np.flatnonzero((of >= 0) & shared[of]) if len(keys) else np.zeros(0, int)
                h, g, rep, _ = _windows(text, at, reps)
                yield _rows(_PART, [{"kind": "ask", "uid": row["uid"], "bucket": n, "a": h[a:z].tobytes(), "b": g[a:z].tobytes(), "c": rep[a:z].tobytes()}
                                    for n, a, z in _split(h, buckets)])
                busy = np.unique(text.doc[at])
                done = np.setdiff1d(np.arange(len(raw)), busy)
                if len(busy):
                    ends, data = _pack([raw[i] for i in busy])
                    # Places of the windows, counted in the words of the documents that go on.
                    shift = text.ends[:-1][busy] - np.cumsum([0, *np.diff(text.ends)[busy]])[:-1]
                    places = (at - shift[np.searchsorted(busy, text.doc[at])]).astype(np.int32)
                    import zstandard
                    yield _rows(_PART, [{"kind": "open", "uid": row["uid"], "a": b"".join(own[i] for i in busy), "b": reps[busy].tobytes(), "c": ends,
                                         "d": data, "e": zstandard.compress(np.diff(places, prepend=np.int32(0)).tobytes())}])
                for i in range(0, len(done), 4096):
                    part = done[i:i + 4096]
                    found = [_result(own[k], int(reps[k]), text.words[k], None, False) for k in part]
                    yield _rows(_PART, [{"kind": "done", "uid": row["uid"], "a": b"".join(own[k] for k in part), "b": reps[part].tobytes(),
                                         "c": np.array([x["n_words"] for x in found], np.int64).tobytes(),
                                         "d": b"".join(bytes.fromhex(x["kept_sha256"]) for x in found)}])

    parts = scratch.put("parts", stored.join(told, "uid", "left").mapInArrow(verify, _PART))
    scratch.drop("batches", "shared")
    earlier = scratch.put("earlier", _answer(parts.filter("kind = 'ask'").select("uid", "bucket", "a", "b", "c"), _earlier))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        names = _Names()
        for b in batches:
            for row in b.to_pylist():
                reps = np.frombuffer(row["b"], np.int64)
                own = [row["a"][i:i + 16] for i in range(0, len(row["a"]), 16)]
                if row["kind"] == "done":
                    n = np.frombuffer(row["c"], np.int64).tolist()
                    yield _rows(_RESULT, [
                        {"class": c, "rep": None if r == LAST else r, "n_words": m, "n_removed": 0, "kept_sha256": row["d"][32 * i:32 * i + 32].hex()}
                        for i, (c, r, m) in enumerate(zip(own, reps.tolist(), n))])
                    continue
                text = Text(_unpack(row["c"], row["d"]), names)
                at = np.cumsum(np.frombuffer(zstandard.decompress(row["e"]), np.int32))
                h, _, least, number = _windows(text, at, reps)
                again = _bits(_split(h, buckets), row["answers"], len(h))[number] | (reps[text.doc[at]] > least[number])
                edge = np.zeros(len(text.name) + 1, np.int64)
                np.add.at(edge, at[again], 1)
                np.add.at(edge, at[again] + WINDOW, -1)
                gone = np.cumsum(edge)[:-1] > 0
                for i in range(0, len(own), 512):
                    yield _rows(_RESULT, [_result(own[k], int(reps[k]), text.words[k], gone[text.ends[k]:text.ends[k + 1]], with_text)
                                          for k in range(i, min(i + 512, len(own)))])

    rest = parts.filter("kind <> 'ask'").join(earlier, "uid", "left")
    out = scratch.put("classes", rest.mapInArrow(finish, _RESULT))
    scratch.drop("parts", "earlier")
    return out


def digest(docs: DataFrame) -> DataFrame:
    """The result of query op4_substrings."""
    scratch = Scratch(docs.sparkSession, "substrings")
    found = classes(docs, scratch)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_class("text").alias("class")).join(found, "class")
    copy = F.col("rep").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("rep"))) & (F.col("n_words") >= WINDOW)
    return rows.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with the remaining words as text where words were removed; n_chars, if there is one, follows."""
    scratch = Scratch(docs.sparkSession, "substrings")
    found = classes(docs, scratch, with_text=True).select(F.struct("*").alias("_found"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), text_class("text").alias("_class"))
    rows = rows.join(found, F.col("_class") == F.col("_found.class"))
    rep, doc_id = F.col("_found.rep"), F.col("_row.doc_id")
    copy = rep.isNotNull() & (doc_id.isNull() | (doc_id > rep)) & (F.col("_found.n_words") >= WINDOW)
    text = F.when(copy, F.lit("")).otherwise(F.coalesce("_found.kept", "_row.text"))
    out = [text.alias(c) if c == "text" else F.char_length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
           else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return rows.select(*out)
