import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vereda.functions import embed
from vereda.functions import text as T
from vereda.operators import evaluate, fusion, lexical, nearest, respcache, setjoin


def vectors(spark, n, dim=8, seed=1, name="id"):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).tolist(), f"g{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>, grp string"), rows


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]),
                                ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(nearest.cosine("a", "b")).collect()] == [1.0, 0.0, -1.0, 0.0]


def test_search_paths_agree_with_brute_force(spark):
    corpus, rows = vectors(spark, 300)
    questions, asked = vectors(spark, 20, seed=2, name="query_id")
    for bound in (2048, 5):  # in-task questions, and the tiled join
        got = {(r["query_id"], r["rank"]): r["id"] for r in nearest.search(corpus.repartition(5), questions, 4, bound=bound).collect()}
        for q, v, _ in asked:
            sims = sorted(((-round(float(np.dot(v, e) / np.linalg.norm(v) / np.linalg.norm(e)), 4), i) for i, e, _ in rows))[:4]
            assert [got[(q, r)] for r in range(1, 5)] == [i for _, i in sims]


def test_per_branch(spark):
    corpus, _ = vectors(spark, 60)
    questions, _ = vectors(spark, 2, seed=3, name="query_id")
    got = nearest.search(corpus, questions, 2, group="grp").groupBy("query_id", "grp").count().collect()
    assert len(got) == 6 and all(r["count"] == 2 for r in got)
    assert nearest.collection_k(4, 8) == 2 and nearest.keyword_k(4, 2) == 3


def test_bm25_brute_force(spark):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choice("a b c d e f g".split()) for _ in range(rnd.randint(3, 12)))) for i in range(30)] + [(30, "z a z")]
    asked = [(0, "a b b"), (1, "z"), (2, "nada")]
    got = {}
    for bound in (2048, 1):
        found = lexical.search(spark.createDataFrame(docs, "id long, text string"),
                               spark.createDataFrame(asked, "query_id long, text string"), 3, bound=bound).collect()
        got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in found}
        toks = {i: t.split() for i, t in docs}
        n, avg = len(docs), sum(len(t) for t in toks.values()) / len(docs)
        df = Counter(w for t in toks.values() for w in set(t))
        raw = {w: math.log(n - c + .5) - math.log(c + .5) for w, c in df.items()}
        eps = .25 * sum(raw.values()) / len(raw)
        idf = {w: v if v >= 0 else eps for w, v in raw.items()}
        for q, text in asked:
            scores = []
            for i, t in toks.items():
                f = Counter(t)
                s = sum(idf.get(w, 0) * f[w] * 2.5 / (f[w] + 1.5 * (.25 + .75 * len(t) / avg)) for w in text.split())
                scores.append((-round(s, 6), i))
            assert [got[(q, r)][0] for r in (1, 2, 3)] == [i for _, i in sorted(scores)[:3]]


def brute_jaccard(a, b):
    return len(a & b) / len(a | b)


def test_jaccard_join_brute_force(spark):
    rnd = random.Random(7)
    sets = {f"s{i}": frozenset(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(1, 9))) for i in range(60)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id string, tokens array<string>")
    for t in (0.15, 0.5, 0.7, 1.0):
        want = {(a, b) for a, b in itertools.product(sets, sets) if brute_jaccard(sets[a], sets[b]) >= t}
        assert {(r[0], r[1]) for r in setjoin.jaccard_join(df, df, t).select("left_id", "right_id").collect()} == want


def test_contains_join(spark):
    names = ["ana maria", "mariana", "jo", "x", "maria"]
    df = spark.createDataFrame([(n, n) for n in names], "id string, text string")
    got = {(r[0], r[1]) for r in setjoin.contains_join(df, df).collect()}
    assert got == {(a, b) for a in names for b in names if a in b}


def pg_trgm(a, b):
    def grams(s):
        return {("  " + w + " ")[i:i + 3] for w in "".join(c if c.isalnum() else " " for c in s.lower()).split() for i in range(len(w) + 1)}
    return brute_jaccard(grams(a), grams(b))


def test_trigram_similarities(spark):
    pairs = [("Inteligência Artificial", "inteligencia artificial"), ("Redes", "Redes de Computadores"), ("abc", "xyz")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(T.jaccard(T.word_trigrams("a"), T.word_trigrams("b"))).collect()]
    assert np.allclose(got, [pg_trgm(a, b) for a, b in pairs])
    whole = df.select(T.string_trigrams("a").alias("g")).first()["g"]
    s = "  " + pairs[0][0] + "  "
    assert set(whole) == {s[i:i + 3] for i in range(len(s) - 2)}


def test_near_tie(spark):
    m = spark.createDataFrame([("q", "PPG", .90), ("q", "Graduação", .87), ("q", "Longe", .5), ("r", "PPG", .9)], "question string, name string, sim double")
    got = {r["question"]: r["name"] for r in setjoin.near_tie_preference(m, F.col("name") == "Graduação").collect()}
    assert got == {"q": "Graduação", "r": "PPG"}


def test_fusion(spark):
    a = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(0, "y", 1), (0, "z", 2)], "query_id int, id string, rank int")
    got = [(r["id"], r["score"]) for r in fusion.rrf([(a, .5), (b, .5)]).orderBy("rank").collect()]
    assert got == [("y", round(.5 / 62 + .5 / 61, 6)), ("x", round(.5 / 61, 6)), ("z", round(.5 / 62, 6))]
    df = spark.createDataFrame([("Falo de Inteligência artificial aqui", "Inteligência Computacional"), ("nada", "Redes Neurais")], "a string, t string")
    assert [r[0] for r in df.select(fusion.cites("a", "t")).collect()] == [True, False]


def test_recall_precision(spark):
    rec = spark.createDataFrame([(0, d, i + 1) for i, d in enumerate("AXBYC")], "query_id int, id string, rank int")
    rel = spark.createDataFrame([(0, d) for d in "ABC"], "query_id int, id string")
    got = {k: evaluate.recall_precision(rec, rel, k, 6).first() for k in (0, 1, 2, 3, 5)}
    assert (got[1]["recall"], got[3]["recall"], got[5]["recall"]) == (round(1 / 3, 6), round(2 / 3, 6), 1.0)
    assert (got[1]["precision"], got[2]["precision"], got[5]["precision"], got[0]["precision"]) == (1.0, .5, .6, 0.0)
    assert evaluate.recall_precision(rec, rel.limit(0), 3).first()["recall"] == 0.0


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_rouge(spark):
    rnd = random.Random(3)
    for _ in range(50):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 15))] for _ in range(2))
        assert evaluate.lcs_length(a, b) == brute_lcs(a, b)
    df = spark.createDataFrame([("o gato comeu", "o rato comeu queijo")], "p string, r string")
    row = evaluate.rouge_l(df, "p", "r").first()
    assert (row["rouge_p"], row["rouge_r"], row["rouge_f1"]) == (round(2 / 3, 4), .5, round(2 * (2 / 3) * .5 / (2 / 3 + .5), 4))


def test_judge(spark):
    df = spark.createDataFrame([('ok {"fidelidade": 12, "relevancia": "7.9", "completude": "x", "justificativa": "j"}',),
                                ('{"fidelidade": 8, "justificativa": "cort',), ("nada",)], "r string")
    got = [tuple(r["j"]) for r in df.select(evaluate.judge("r").alias("j")).collect()]
    assert got == [(10, 7, None, "j"), (8, None, None, "cort"), (None, None, None, None)]


def test_cache(spark):
    times = [0, 10, 3600, 3601, 5000, 7300, 9000]
    req = spark.createDataFrame([("k", t) for t in times] + [("k", 10)], "key string, sec long")
    got = sorted((r["created"], r["hits"]) for r in respcache.exact_entries(req).collect())
    assert got == [(0, 3), (3601, 1), (7300, 1)]


def test_embedder(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "")], "id long, text string")
    got = {r["id"]: r["embedding"] for r in embed.embed(df, "text").collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-9 and not any(got[2])
    assert embed.check_dimension(embed.embed(df, "text"), 64).isEmpty()

    class Flaky:
        def embed_documents(self, texts):
            if "ruim" in texts:
                raise OSError("429")
            return [[1.0] for _ in texts]

    docs = spark.createDataFrame([(1, "bom"), (2, "ruim")], "id long, text string").coalesce(1)
    rows = {r["id"]: r for r in embed.embed_with(docs, "text", Flaky(), batch=1).collect()}
    assert rows[1]["embedding"] == [1.0] and rows[1]["error"] is None
    assert rows[2]["embedding"] is None and rows[2]["error"] == "OSError: 429"


def test_rows_without_vector_are_no_candidates(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.1]), (8, None)], "query_id long, embedding array<double>")
    assert [(r["query_id"], r["id"]) for r in nearest.search(corpus, asked, 5).orderBy("rank").collect()] == [(7, 1), (7, 3)]


def test_similarity_joins_broadcast_no_texts(spark, tmp_path):
    """By their file's size the texts look small enough; their exploded trigrams are not."""
    from vereda.operators import respcache
    spark.range(50).selectExpr("id", "concat('qual o prazo da disciplina ', id) AS question", "id AS sec", "id AS created").write.parquet(f"{tmp_path}/q")
    q = spark.read.parquet(f"{tmp_path}/q")
    found = respcache.lookup_fuzzy(q.select("id", "question", "sec"), q.select("question", "created"))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert found.count() == 50


def test_scoring_holds_bounded_pieces(monkeypatch):
    texts = ["a b", "x" * 50, "", "c", "d e f", "g"]
    monkeypatch.setattr(embed, "HELD_CHARS", 6)
    monkeypatch.setattr(embed, "HELD_ROWS", 2)
    assert list(embed.spans(texts)) == [(0, 1), (1, 2), (2, 4), (4, 6)]
    assert list(embed.spans([])) == []
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [[rng.choice(words) for _ in range(rng.randrange(30))] for _ in range(60)] + [["unseen"], []]
    block = lexical.term_matrix([[{"term": w, "w": rng.random()} for w in rng.sample(words, 9)] for _ in range(25)] + [None])
    stats = lexical.Stats(62, 14.0, 0.1)
    whole = lexical.score_tokens(docs, block, stats)
    for held in (1, 7, 300):
        monkeypatch.setattr(lexical, "HELD_PRODUCTS", held)
        assert np.array_equal(lexical.score_tokens(docs, block, stats), whole)


def test_blocked_join_brute_force(spark, monkeypatch):
    """In memory, part by part, by prefixes and all at once; rows may come twice, and NULL is in no block."""
    rnd = random.Random(11)

    def texts(n):
        rows = [(rnd.choice([-1, 0, 0, 7]), "".join(rnd.choice("ab ç") for _ in range(rnd.choice([0, 1, 2, 5, 9, 14])))) for _ in range(n)]
        return rows + rows[:5] + [(None, "ab"), (0, None)]

    def grams(s):
        s = "  " + s + "  "
        return {s[i:i + 3] for i in range(len(s) - 2)}

    left, right = texts(60), texts(40)
    frames = [spark.createDataFrame(rows, "block long, text string") for rows in (left, right)]
    key = {r["text"]: r["id"] for f in frames for r in f.select("text", setjoin.text_id("text").alias("id")).collect()}
    sets = [f.filter("block IS NOT NULL").distinct().select(F.col("text").alias("id"), "block", T.string_trigrams("text").alias("tokens")) for f in frames]
    for threshold, held, most in ((.3, 1 << 21, 32), (.5, 150, 32), (.5, 150, 1), (.5, 150, 4), (1.0, 150, 4)):
        monkeypatch.setattr(setjoin, "HELD_TOKENS", held)
        monkeypatch.setattr(setjoin, "MOST_PARTS", most)
        want = {(a, b, k): round(brute_jaccard(grams(a), grams(b)), 6) for k, a in set(left) for j, b in set(right)
                if k == j and None not in (k, a, b) and brute_jaccard(grams(a), grams(b)) >= threshold}
        for given, of, ids in ((frames, T.string_trigrams, key), (sets, None, {t: t for t in key})):
            got = setjoin.jaccard_join(*given, threshold, blocked=True, of=of).collect()
            assert len(got) == len(want)
            assert {(r["left_id"], r["right_id"], r["block"]): r["sim"] for r in got} == {(ids[a], ids[b], k): s for (a, b, k), s in want.items()}


def test_overlaps_in_pieces(monkeypatch):
    rnd = random.Random(5)

    def side(n):
        sets = [rnd.sample(range(-20, 20), rnd.randint(0, 9)) for _ in range(n)]
        return sets, (np.array([len(s) for s in sets]), np.array([c for s in sets for c in s]))

    (left, le), (right, ri) = side(40), side(25)
    for threshold, held in itertools.product((.1, .4, .82, 1.0), (1, 9, 1 << 19)):
        monkeypatch.setattr(setjoin, "HELD_PRODUCTS", held)
        got = [p for piece in setjoin.overlaps(*le, *ri, threshold) for p in zip(*(x.tolist() for x in piece))]
        want = {(i, j, len(set(a) & set(b))) for (i, a), (j, b) in itertools.product(enumerate(left), enumerate(right))
                if a and b and brute_jaccard(set(a), set(b)) >= threshold}
        assert len(got) == len(set(got)) and set(got) == want


def test_fuzzy_lookup_moves_texts_not_tokens(spark, tmp_path):
    """Each text goes to its slices once; rows for each of its trigrams filled the disk."""
    spark.range(50).selectExpr("id", "concat('qual o prazo da disciplina ', id) AS question", "id AS sec", "id AS created").write.parquet(f"{tmp_path}/q")
    q = spark.read.parquet(f"{tmp_path}/q")
    found = respcache.lookup_fuzzy(q.select("id", "question", "sec"), q.select("question", "created"))
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    generated = [line for line in plan.splitlines() if "Generate" in line]
    assert generated and not [line for line in generated if "code" in line or "token" in line]
    # What the trigrams are made of is moved before they are made.
    made = next(i for i, line in enumerate(plan.splitlines()) if "regexp_extract_all" in line)
    moved = next(i for i, line in enumerate(plan.splitlines()) if "REPARTITION_BY_COL" in line)
    assert made < moved


def test_fuzzy_lookup_first_of_equal_age(spark):
    """Of the entries of one second the lesser text serves, whatever its id; copies of an id are one request."""
    entries = spark.createDataFrame([("prazo da matricula b", 10), ("prazo da matricula a", 10), ("prazo da matricula", 3700)], "question string, created long")
    requests = spark.createDataFrame([("r", 3605, "prazo da matricula"), ("r", 3605, "prazo da matricula"), ("s", 3611, "prazo da matricula"), ("t", 3700, None)],
                                     "id string, sec long, question string")
    got = {r["id"]: (r["created"], r["entry"]) for r in respcache.lookup_fuzzy(requests, entries).collect()}
    assert got == {"r": (10, "prazo da matricula a")}
