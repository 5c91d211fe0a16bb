"""SuperMinHash near-duplicates, periodic runs and token alignment against brute force and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import awkward_rows
from vereda.llm import alignment, catalog, minhash, runs
from vereda.llm.common import Scratch

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# --- near-duplicates -----------------------------------------------------------------------


def shingle_set(text, size=2):
    w = WORDS.findall((text or "").encode().translate(LOWER))
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_components(rows, size=2, share=80):
    """Per row: size of its set, least id reachable."""
    sets = [shingle_set(t, size) for _, t in rows]
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= share * len(x | sets[j]):
                group[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return [(doc_id, len(sets[i]), least.get(top(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)]


def near_rows(seed=2, groups=25):
    """Texts of all lengths with copies edited around the threshold, chains included."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        text = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 8, 30, 90, 300]))]
        for _ in range(rng.randint(1, 8)):
            rows.append((len(rows) * 3 % 1009, " ".join(text)))
            text = list(text)
            for _ in range(rng.randint(0, 1 + len(text) // 18)):
                text[rng.randrange(len(text))] = rng.choice(words)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile", [2048, 3])
def test_minhash_equals_brute_force(spark, tile):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash.near_duplicates(df, tile=tile).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_on_the_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.digest(docs).collect())
    assert got == sorted(brute_components(rows))


def test_minhash_five_words_and_proposals(spark):
    rows = near_rows(5, 12)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = df.select(F.unhex(F.md5("text")).alias("a")).crossJoin(df.select(F.unhex(F.md5("text")).alias("b"))).limit(40)
    found = minhash.linked(df, Scratch(spark, "t"), size=5, proposed=pairs).collect()
    groups = {bytes(r["class"]): r.root for r in found}
    by_root = {}
    for doc_id, text in rows:
        by_root.setdefault(groups[hashlib.md5(text.encode()).digest()], set()).add(doc_id)
    want = {}
    for doc_id, _, component in brute_components(rows, 5):
        want.setdefault(component, set()).add(doc_id)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, want.values()))


def test_minhash_awkward(awkward, empty):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.digest(awkward).collect()]
    assert sorted(got, key=repr) == sorted(brute_components(rows), key=repr)
    assert minhash.digest(empty).count() == 0


def test_signatures_estimate_resemblance_and_do_not_depend_on_batches():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    sets = [x[:300], x[60:360], x[:1], x, x[:0], x[5_000:]]
    together = minhash.signatures(sets, 256)
    assert all((minhash.signatures([s], 256)[0] == row).all() for s, row in zip(sets, together))
    same = lambda i, j: (together[i] == together[j]).mean()
    assert abs(same(0, 1) - 240 / 360) < 0.1 and same(3, 5) > 0.8 and same(0, 0) == 1
    # A set of one element fills every level once: places are a permutation.
    assert sorted(int(v) >> 32 for v in together[2]) == list(range(256))


# --- periodic runs -------------------------------------------------------------------------


def brute_runs(token, least):
    found, n = {}, len(token)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if token[i] != token[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and token[i] == token[i + q]:
                i += 1
            length = i + q - s
            if length >= max(least, 2 * q):
                found.setdefault((s, length), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def fast_runs(documents, least):
    lengths = np.array([len(d) for d in documents], np.int64)
    ends = np.cumsum(lengths)
    token = np.array([x for d in documents for x in d], np.int64)
    return [tuple(r) for r in runs.find_runs(token, np.repeat(ends - lengths, lengths), np.repeat(ends, lengths), least).tolist()]


def test_runs_equal_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        documents = []
        for _ in range(rng.randint(1, 4)):
            n, of = rng.randint(0, 50), rng.choice([1, 2, 3, 9])
            d = [rng.randrange(of) for _ in range(n)]
            if n and rng.random() < 0.5:
                a, p = rng.randrange(n), rng.randint(1, 9)
                d = [d[i] if i < a else d[min(n - 1, a + (i - a) % p)] for i in range(n)]
            documents.append(d)
        want, base = [], 0
        for d in documents:
            want += [(s + base, length, q) for s, length, q in brute_runs(d, 2)]
            base += len(d)
        assert sorted(fast_runs(documents, 2)) == sorted(want)


@pytest.mark.parametrize("token", [[1] * 60_000, [5, 6, 7] * 20_000 + [9] + [5, 6] * 9_000, [x for x in range(1, 250) for _ in range(x)]])
def test_runs_of_long_periodic_texts(token):
    got = fast_runs([token], 12)
    assert got and all(token[s:s + n - q] == token[s + q:s + n] for s, n, q in got)
    assert len(got) == (1 if token[-1] == 1 else 2 if token[-1] == 6 else 238)


def expected_runs(doc_id, text):
    words = [] if text is None else WORDS.findall(text.encode())
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words, 12)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found).encode()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *shown, sha(listed), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_runs_query_equals_brute_force(spark, docs):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("ab cd ef gh".split()) for _ in range(n))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(i, say(rng.randint(0, 80))) for i in range(10_000, 10_200)]
    got = runs.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected_runs(*r)) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > 20


def test_runs_awkward(spark, awkward, empty):
    short = awkward.filter("doc_id IS NULL OR doc_id <> 7")
    want = [expected_runs(r[0], r[1]) for r in awkward_rows() if r[0] != 7]
    assert sorted(map(repr, map(tuple, runs.digest(short).collect()))) == sorted(map(repr, want))
    long = runs.digest(awkward.filter("doc_id = 7")).collect()[0]
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 80_000, 2)
    assert runs.digest(empty).count() == 0
    big = 2**60 + 1
    out = runs.collapsed(spark.createDataFrame([(big, "a b c " * 6), (None, None)], "doc_id long, text string")).collect()
    assert {(r.doc_id, tuple(map(tuple, r.runs)), r.text) for r in out} == {(big, ((0, 18, 3),), "a b c"), (None, (), "")}


# --- token alignment -----------------------------------------------------------------------


def expected_alignment(rows):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    made = []
    for _, text in rows:
        groups, links = [], []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
            # Offsets count characters of the text; pieces of one character end together, so bytes are counted here.
            chars = [a.id_to_token(i) for i in x.ids]
            ends_a = np.cumsum([len(c) for c in chars]).tolist()
            size = lambda p: 1 if re.fullmatch("<0x[0-9A-F]{2}>", p) else len(p.replace("▁", " ").encode())
            ends_b = np.cumsum([size(b.id_to_piece(i)) for i in y]).tolist()
            if ends_a[-1] == ends_b[-1] == len(text.encode()) + 1 and b.decode(y) == text:
                ids, both = (x.ids, y), sorted(set(ends_a) & set(ends_b))
                last = 0
                for end in both:
                    groups.append(tuple([i for i, e in zip(side, ends) if last < e <= end] for side, ends in zip(ids, (ends_a, ends_b))))
                    last = end
                links = [(i, j) for i, e in zip(x.ids, ends_a) for j, f in zip(y, ends_b) if e == f]
        made.append((groups, links))
    counts = Counter(p for _, links in made for p in links)
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(n, best.get(j, 0))
    out = []
    for (doc_id, _), (groups, links) in zip(rows, made):
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                    sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(listed.encode()).hexdigest() if listed else ""))
    return out


def same_alignment(spark, rows, monkeypatch, size):
    monkeypatch.setattr(alignment, "BLOCK_ROWS", size)
    got = alignment.counted(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), *catalog.token_sides())
    shown = sorted(repr((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in got.collect())
    assert shown == sorted(map(repr, expected_alignment(rows)))


def test_alignment_equals_brute_force(spark, docs, monkeypatch):
    rows = [(r.doc_id, r.text[:1500]) for r in docs.limit(40).collect()]
    rows += [(900, "<|endoftext|> and <s> plain"), (901, "naïve 日本語 😀 ▁ x"), (902, "  two  spaces \t\n"), (903, None), (904, ""), (None, "same"), (905, "same")]
    same_alignment(spark, rows, monkeypatch, 4000)


def test_alignment_awkward(awkward, empty):
    got = alignment.counted(awkward, *catalog.token_sides()).collect()
    assert len(got) == len(awkward_rows())
    blank = [r for r in got if r.doc_id in (4, 5)]
    assert all((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (0, 0, 0, 0, 0, 0, "") for r in blank)
    assert all(r.n_links > 0 and r.n_best <= r.n_links <= r.count_sum for r in got if r.doc_id in (1, 7, 12))
    assert alignment.counted(empty, *catalog.token_sides()).count() == 0
    out = alignment.aligned(awkward.filter("doc_id = 8"), *catalog.token_sides()).collect()[0]
    assert len(out.a_ends) == len(out.b_ends) and out.a_ends[-1] == len(out.a_ids) and out.b_ends[-1] == len(out.b_ids)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
def test_merge_path_pieces_find_all_common_ends(piece):
    rng = random.Random(piece)
    for _ in range(60):
        a, b = (np.array(sorted(rng.sample(range(1, 80), rng.randint(0, 40))), np.int64) for _ in range(2))
        i, j = alignment.common_ends(a, b, piece)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        cut_a, cut_b = alignment.diagonal_splits(a, b, piece)
        assert (np.diff(cut_a) >= 0).all() and (np.diff(cut_b) >= 0).all()
        assert (np.diff(cut_a) + np.diff(cut_b) <= piece + 1).all()


def test_both_encoders_agree(docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    fast, tokens = alignment.byte_level(path, public_tokenizers.PATTERN)
    slow, same = alignment.byte_level(path)
    texts = [r.text for r in docs.limit(60).collect()] + [
        "<|endoftext|> it's  we'LL　x​ y \n\n z", "é à 日本語 😀 ١٢٣ " * 30, "a" * 5000, " " * 3000 + "x", "😀" * 900, "_" * 200_000]
    assert tokens == same and fast(texts) == slow(texts)
