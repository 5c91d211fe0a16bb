"""Operators on document texts against brute force and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import awkward_rows
from vereda.llm import bpe, catalog, fingerprints, langid, mixing, nearcopies, quality, sharding, simhash, substrings

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
order = lambda rows: sorted(rows, key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# --- language identification ---------------------------------------------------------------


def test_language_held_out_accuracy(spark, docs):
    told = {r.doc_id: r for r in docs.collect()}
    rows = langid.digest(docs).collect()
    assert len(rows) == len(told)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == told[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_language_awkward(awkward, empty):
    rows = langid.digest(awkward).collect()
    assert len(rows) == len(awkward_rows())
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (4, 5, 6, 9))
    assert langid.digest(empty).count() == 0
    kept = langid.accepted(awkward)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, None, 7, 8, 10, 11, 12, 13, -5}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 40])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n


def test_language_ambiguity():
    import pandas as pd

    same = pd.DataFrame([(lang, b, 5) for lang in ("aa", "bb") for b in range(40)], columns=["lang", "bucket", "n"])
    assert langid.Model(same).predict("hello there")[2]


# --- fingerprints --------------------------------------------------------------------------


def shingles(text, size=5):
    w = WORDS.findall(text or "")
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_fingerprints(rows, source):
    """source: (id, text) in descending order."""
    ids = [i for i, _ in source]
    body = [t or "" for _, t in source]
    after = body[1:] + body[:1]
    edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(body, after)]
    got = {r.doc_id: r for r in rows}
    for i, t, n, e in zip(ids, body, after, edited):
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(shingles(t), shingles(e))) < 0.15
        assert abs(r.near_next - jaccard(shingles(t), shingles(n))) < 0.15
        if len(shingles(t) | shingles(e)) <= fingerprints.K:
            assert r.near_edited == pytest.approx(jaccard(shingles(t), shingles(e)))


def test_fingerprints(docs, texts):
    check_fingerprints(fingerprints.digest(docs).collect(), sorted(texts.items(), reverse=True))


def test_fingerprints_many_blocks(docs, texts, monkeypatch):
    monkeypatch.setattr(fingerprints, "SEGMENTS", 5)
    monkeypatch.setattr(fingerprints, "BLOCK", 4)
    check_fingerprints(fingerprints.digest(docs).collect(), sorted(texts.items(), reverse=True))


def test_fingerprints_awkward(awkward, empty):
    rows = fingerprints.digest(awkward).collect()
    assert len(rows) == len(awkward_rows())
    by_text = {}
    for (i, t, *_), in zip(awkward_rows()):
        by_text.setdefault(t or "", set()).update(r.fingerprint for r in rows if r.doc_id == i and i is not None and i != 2)
    assert all(len(x) <= 1 for x in by_text.values())
    assert fingerprints.digest(empty).count() == 0
    one = awkward.filter("doc_id = 3")
    assert fingerprints.digest(one).first().near_next == 1.0


def test_sketches_merge(spark):
    df = spark.createDataFrame([("a b c d e f", "a b c d e f g h")], "a string, b string")
    a, b = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    row = df.select(fingerprints.merge(a, b).alias("m"), b.alias("b"), fingerprints.containment(a, b).alias("c"),
                    fingerprints.distinct_count(b).alias("n")).first()
    assert row.m == row.b and row.c == pytest.approx(1.0) and row.n == 4


# --- mixing --------------------------------------------------------------------------------


def brute_mixture(rows, targets=None, seed=mixing.SEED):
    n = Counter(s for _, s in rows)
    weight = {s: (c ** mixing.TEMPERATURE if targets is None else targets.get(s, 0)) for s, c in n.items()}
    out = Counter()
    for i, s in rows:
        rate = len(rows) * weight[s] / sum(weight.values()) / n[s]
        u = int(hashlib.md5(f"{seed}:{chr(92) + 'N' if i is None else i}".encode()).hexdigest()[:12], 16) / 2 ** 48
        k, total = 0, math.exp(-rate)
        while total <= u:
            k += 1
            total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate > 0 else 1
        out[i, s] += k
    return {x: k for x, k in out.items() if k}


def test_mixing_awkward(awkward, empty):
    rows = [(r[0], r[3]) for r in awkward_rows()]
    got = mixing.digest(awkward)
    assert Counter((r.doc_id, r.source) for r in got.collect()) == Counter(brute_mixture(rows))
    assert mixing.digest(empty).count() == 0
    assert mixing.mix(awkward).columns == awkward.columns


def test_mixing_targets(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("source"))
    n = {r.source: r["count"] for r in mixing.mix(docs, targets={"rare": 3.0, "common": 1.0}).groupBy("source").count().collect()}
    assert n["rare"] == pytest.approx(15_000, rel=0.05) and n["common"] == pytest.approx(5_000, rel=0.05)
    assert mixing.mix(docs, targets={"rare": 1.0}).filter("source = 'common'").count() == 0


def test_mixing_sql(docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = mixing.digest(docs)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({mixing.ORACLE})").fetchall()
    assert order(map(tuple, got.collect())) == order(want)


# --- substring dedup -----------------------------------------------------------------------


def brute_removed(rows):
    """rows: (id or None, text). NULL ids come last and copies of any id go."""
    key = lambda i: math.inf if i is None else i
    first, out = {}, []
    split = [(key(i), WORDS.findall(t or "")) for i, t in rows]
    for i, w in split:
        for at in range(len(w) - 12):
            k = " ".join(w[at:at + 13])
            first[k] = min(first.get(k, math.inf), i)
    for (i, w), (real, _) in zip(split, rows):
        gone = [False] * len(w)
        for at in range(len(w) - 12):
            if first[" ".join(w[at:at + 13])] < i:
                gone[at:at + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((real, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substrings(docs, texts):
    assert order(map(tuple, substrings.digest(docs).collect())) == order(brute_removed(texts.items()))


def test_substrings_small_batches(docs, texts, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_BYTES", 20_000)
    monkeypatch.setattr(substrings, "ANSWERED", 2_000)
    assert order(map(tuple, substrings.digest(docs).collect())) == order(brute_removed(texts.items()))


def test_substrings_awkward(awkward, empty):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    assert order(map(tuple, substrings.digest(awkward).collect())) == order(brute_removed(rows))
    assert substrings.digest(empty).count() == 0
    cut = substrings.deduplicated(awkward)
    assert cut.columns == awkward.columns
    got = order((r.doc_id, r.text or "") for r in cut.collect())
    want = []
    for (i, t), (_, n, gone, _) in zip(rows, brute_removed(rows)):
        want.append((i, gone, t))
    assert len(got) == len(want)
    assert [t for i, t in got if i == 2] == ["" if g == 60 else t for i, g, t in want if i == 2]
    assert [r.n_chars for r in cut.filter("doc_id = 13").collect()] == [len(r.text) for r in cut.filter("doc_id = 13").collect()]


def test_equal_windows_pick_equal_symbols():
    rng = np.random.default_rng(2)
    body = [" ".join(rng.choice(list("abcde"), 400)) for _ in range(6)]
    text = substrings.Text([t.encode() for t in body], substrings._Names())
    picked, flat, seen = text.picked(), [w for d in text.words for w in d], {}
    for at in np.flatnonzero(picked):
        assert seen.setdefault(b" ".join(flat[at:at + 13]), picked[at]) == picked[at]


# --- byte-level BPE ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    path, pattern = catalog.public_vocabulary()
    return bpe.Codec(bpe.read_ranks(path), pattern)


@pytest.fixture(scope="module")
def library(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=catalog.public_vocabulary()[1], mergeable_ranks=codec.ranks, special_tokens={})


def test_bpe_matches_library(codec, library, texts):
    rng = np.random.default_rng(3)
    tokens = list(codec.ranks)
    mixed = [b"".join(tokens[k] for k in rng.integers(0, len(tokens), 6)).decode("utf-8", "ignore") for _ in range(2_000)]
    runs = ["a" * 5_000, " " * 3_000 + "x", "ñ" * 2_000, "", "\r\n\x85　 <|endoftext|> 😀"]
    for t in [*texts.values(), *mixed, *runs]:
        ids = codec.encode(t)
        assert ids == library.encode_ordinary(t) and codec.decode(ids) == t.encode()


def test_bpe_awkward(awkward, empty, library):
    path, pattern = catalog.public_vocabulary()
    want = []
    for i, t, *_ in awkward_rows():
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert order(map(tuple, bpe.digest(awkward, path, pattern).collect())) == order(want)
    assert bpe.digest(empty, path, pattern).count() == 0
    back = bpe.decode(bpe.encode(awkward.select("doc_id", "text"), path, pattern), path, pattern, text="back")
    assert back.filter("back <> coalesce(text, '')").count() == 0


# --- quality -------------------------------------------------------------------------------


def test_quality_held_out(spark):
    rows = [(i, (" ".join(f"word{(i * 7 + k * 3) % 97}" for k in range(40)) + ".") if i % 4 else "BUY!! NOW!! " * 15) for i in range(1_200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 1_200, 3)], "doc_id long, quality int")
    got = quality.digest(docs, labels).collect()
    assert len(got) == 1_200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in got if r.held_out) >= 0.97 * sum(r.held_out for r in got)
    assert quality.learn(docs, labels).prior == pytest.approx(0.75, abs=0.12)


def test_quality_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (99, 1)], "doc_id long, quality int")
    rows = quality.digest(awkward, labels).collect()
    assert len(rows) == len(awkward_rows()) and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    assert quality.digest(empty, labels.limit(0)).count() == 0


def test_quality_of_a_fully_labelled_table(spark):
    rows = [(i, (" ".join(f"word{(i * 7 + k * 3) % 97}" for k in range(40)) + ".") if i % 4 else "BUY!! NOW!! " * 15) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int")
    got = quality.digest(docs, labels).collect()
    assert min(r.score for r in got if r.doc_id % 4) > max(r.score for r in got if r.doc_id % 4 == 0)


@pytest.mark.parametrize("prior", [None, 0.2, 0.9])
def test_quality_descends_the_stated_risk(prior):
    """Adam along finite differences of the risk, written out, on the same draws."""
    rng = np.random.default_rng(9)
    p, u = rng.normal(0.6, 1, (40, 3)), rng.normal(0, 1, (70, 3))

    def loss(z, y):
        return np.mean([math.log1p(math.exp(-y * x)) for x in z])

    def risk(w, a, b):
        za, zb = a @ w[:3] + w[3], b @ w[:3] + w[3]
        if prior is None:
            return loss(za, 1) + loss(zb, -1)
        negative = loss(zb, -1) - prior * loss(za, -1)
        return prior * loss(za, 1) + negative if negative >= 0 else -negative

    draws, w, m, v, steps = np.random.default_rng(5), np.zeros(4), np.zeros(4), np.zeros(4), 12
    for step in range(1, steps + 1):
        a, b = p[draws.integers(0, 40, 256)], u[draws.integers(0, 70, 512)]
        slope = np.array([(risk(w + e, a, b) - risk(w - e, a, b)) / 2e-6 for e in np.eye(4) * 1e-6])
        slope[:3] += 1e-3 * w[:3]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope ** 2
        w = w - 0.02 / (1 + 3 * step / steps) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    got, bias = quality._descend(p, u, prior, 5, steps)
    assert np.allclose([*got, bias], w, atol=1e-5)


# --- sharding ------------------------------------------------------------------------------


def check_shards(rows, source, shards, slack):
    assert order((r.doc_id, r["size"], r.text_crc32) for r in rows) == order(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in source)
    for s in {r.shard for r in rows}:
        assert 0 <= s < shards and sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    total = sum(r["size"] for r in rows)
    for s in range(shards):
        assert abs(sum(r["size"] for r in rows if r.shard == s) - total / shards) <= slack


def test_sharding(docs, texts):
    most = max(len(t.encode()) for t in texts.values()) + 8
    rows = sharding.digest(docs, shards=4).collect()
    check_shards(rows, texts.items(), 4, 1.5 * most)
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)


def test_sharding_splits_hot_text(spark):
    """One text with most rows is cut by id, and its cell is dealt out."""
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same text").otherwise(F.concat(F.lit("other text "), "id")).alias("text"))
    rows = sharding.digest(docs, shards=8).collect()
    source = [(r.doc_id, r.text) for r in docs.collect()]
    check_shards(rows, source, 8, 120)


def test_sharding_awkward(awkward, empty):
    rows = sharding.digest(awkward).collect()
    assert order((r.doc_id, r.text_crc32) for r in rows) == order((r[0], zlib.crc32((r[1] or "").encode())) for r in awkward_rows())
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(24))
    assert sharding.digest(empty).count() == 0


# --- SimHash -------------------------------------------------------------------------------


def brute_print(text):
    w = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints, radius=2):
    """prints: list of numbers; the component number of each."""
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(x) for x in range(len(prints))]


def check_simhash(rows, source):
    prints = [brute_print(t) for _, t in source]
    parts = brute_components(prints)
    least = {}
    for (i, _), p in zip(source, parts):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    want = [(i, f"{f:016x}", least.get(p)) for (i, _), f, p in zip(source, prints, parts)]
    assert order(map(tuple, rows)) == order(want)


def test_simhash(docs, texts):
    check_simhash(simhash.digest(docs).collect(), list(texts.items()))


def test_simhash_awkward(awkward, empty):
    check_simhash(simhash.digest(awkward).collect(), [(r[0], r[1]) for r in awkward_rows()])
    assert simhash.digest(empty).count() == 0


@pytest.mark.parametrize("tile", [2, 8, 2048])
def test_simhash_links_dense_group(spark, tile):
    """Fingerprints a few bits apart, many in one block: tiles connect what brute force connects."""
    rng = np.random.default_rng(8)
    prints = {0x0123456789ABCDEF}
    while len(prints) < 150:
        x = rng.choice(sorted(prints))
        prints.add(int(x) ^ sum(1 << int(b) for b in rng.integers(0, 63, 3)))
    prints = sorted(prints)
    nodes = spark.createDataFrame([(p, p) for p in prints], "node long, fp long")
    scratch = simhash.Scratch(spark, "test")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, scratch, 2, tile), scratch).collect()}
    parts = brute_components(prints)
    for a in range(len(prints)):
        for b in range(a):
            assert (parts[a] == parts[b]) == (roots.get(prints[a], prints[a]) == roots.get(prints[b], prints[b]))


def test_components_chain(spark):
    """A long chain, numbered at random, and a star."""
    ids = np.random.default_rng(1).permutation(300).tolist()
    edges = [(min(a, b), max(a, b)) for a, b in zip(ids, ids[1:])] + [(1000, 1000 + k) for k in range(1, 200)]
    rows = simhash.components(spark.createDataFrame(edges, "a long, b long"), simhash.Scratch(spark, "test")).collect()
    assert len({r.root for r in rows if r.node < 1000}) == 1 and len({r.root for r in rows if r.node >= 1000}) == 1
    assert len(rows) == 500


def test_representatives(spark, docs, texts, awkward, empty):
    rng = np.random.default_rng(4)
    base = " ".join(f"w{k}" for k in rng.integers(0, 5000, 300))
    near = base.replace(base.split()[150], "changed", 1)
    far = " ".join(f"v{k}" for k in rng.integers(0, 5000, 300))
    rows = spark.createDataFrame([(5, base), (9, near), (7, far), (8, far), (11, base)], "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.representatives(rows).collect()) == [5, 7]
    kept = nearcopies.representatives(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and 1 in ids and 2 not in ids and len(ids) == len(set(ids)) + 1
    assert nearcopies.representatives(empty).count() == 0
    left = {r.doc_id for r in nearcopies.representatives(docs).collect()}
    sets = {i: shingles(t.lower()) for i, t in texts.items()}
    for i in texts.keys() - left:
        assert any(jaccard(sets[i], sets[j]) >= 0.7 for j in texts if j < i)
    assert len({texts[i] for i in left}) == len(left)


def test_representatives_exact(spark):
    """Pairs just above 0.8 go and pairs just below stay, however far their fingerprints are, as brute force decides."""
    rng = np.random.default_rng(11)
    rows, pairs = [], []
    for k in range(400):
        words = [f"w{x}" for x in rng.integers(0, 10**6, rng.integers(30, 600))]
        other = list(words)
        for at in rng.choice(len(words), max(1, round(len(words) * rng.uniform(0.015, 0.035))), replace=False):
            other[at] = f"v{rng.integers(0, 10**6)}"
        a, b = " ".join(words), " ".join(other)
        rows += [(2 * k, a), (2 * k + 1, b)]
        pairs.append((k, jaccard(shingles(a), shingles(b))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fp = {r.doc_id: r.fp % 2**64 for r in simhash.described(df).collect()}
    pairs = [(k, s, (fp[2 * k] ^ fp[2 * k + 1]).bit_count()) for k, s in pairs]
    left = {r.doc_id for r in nearcopies.representatives(df).collect()}
    assert all(2 * k in left for k, _, _ in pairs)
    assert sum(0.75 <= s < 0.8 for _, s, _ in pairs) > 30 and sum(0.8 <= s < 0.85 for _, s, _ in pairs) > 30
    assert sum(s >= 0.8 and bits > 9 for _, s, bits in pairs) >= 3
    assert not [(s, bits) for k, s, bits in pairs if (2 * k + 1 not in left) != (s >= 0.8)]


def test_representatives_of_repeated_ids(spark):
    """No text goes because another text has its id."""
    rng = np.random.default_rng(6)
    a, b, c = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 80)) for _ in range(3))
    rows = spark.createDataFrame([(1, a), (1, b), (5, b), (2, c), (2, c)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in nearcopies.representatives(rows).collect()) == sorted([(1, a), (1, b), (2, c)])


def test_language_nothing_learned(awkward):
    """Without any language to learn, documents with letters stay."""
    kept = langid.accepted(awkward.withColumn("lang", F.lit(None).cast("string")))
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [-5, 1, 2, 2, 3, 7, 8, 10, 11, 12, 13]
