"""Vector, lexical and fused retrieval over whole tables.

The questions of the vector queries are one prototype per source: the mean of
all vectors with the same label.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion, lexical, nearest, setjoin
from .registry import query

# --- SQL building blocks ------------------------------------------------------

PROTOTYPES_SQL = """
dims AS (SELECT label, i, round(avg(embedding[i]::DOUBLE), 6) AS m
         FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
proto AS (SELECT label AS query_id, list(m ORDER BY i) AS q FROM dims GROUP BY label)"""

CORPUS_SQL = "corpus AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"

SCORE_SQL = {
    "cosine": ("list_cosine_similarity(e, q)", "DESC"),
    "l2": ("list_distance(e, q)", "ASC"),
    "l1": ("list_sum(list_transform(list_zip(e, q), lambda p: abs(p[1] - p[2])))", "ASC"),
    "ip": ("-list_inner_product(e, q)", "ASC"),
}


def _pairs_sql(metric: str = "cosine") -> str:
    expr, _ = SCORE_SQL[metric]
    return f"""WITH {PROTOTYPES_SQL}, {CORPUS_SQL},
pairs AS (SELECT query_id, id, label, round({expr}, 4) + 0.0 AS score FROM corpus, proto)"""


def _topk_sql(metric: str, k: int) -> str:
    return f"""{_pairs_sql(metric)},
ranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score {SCORE_SQL[metric][1]}, id) AS rank FROM pairs)
SELECT query_id, id, score, rank FROM ranked WHERE rank <= {k}"""


def _corpus(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "label", "embedding")


def _questions(t):
    return nearest.prototypes(t.embeddings, "label").withColumnRenamed("label", "query_id")


def _register_metric(metric: str) -> None:
    @query(f"vec_{metric}_topk", _topk_sql(metric, 10))
    def run(t):
        return nearest.search(_corpus(t), _questions(t), 10, metric)


for _m in nearest.METRICS:
    _register_metric(_m)


@query("vec_topk_per_label_then_global", f"""{_pairs_sql()},
branch AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS b FROM pairs),
ranked AS (SELECT query_id, id, label AS grp, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
           FROM branch WHERE b <= 3)
SELECT query_id, id, grp, score, rank FROM ranked WHERE rank <= 6""")
def vec_topk_per_label_then_global(t):
    return nearest.branch_then_global(_corpus(t), _questions(t), 6, "label", per_branch=nearest.collection_k(6, 10) + 1)


@query("vec_metadata_filtered_topk", f"""{_pairs_sql()},
kept AS (SELECT p.* FROM pairs p JOIN documents d ON d.doc_id = p.id WHERE d.lang = 'en'),
ranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM kept)
SELECT query_id, id, score, rank FROM ranked WHERE rank <= 6""")
def vec_metadata_filtered_topk(t):
    english = t.documents.filter(F.col("lang") == "en").select(F.col("doc_id").alias("id"))
    return nearest.search(_corpus(t).join(english, "id", "left_semi"), _questions(t), 6)


@query("vec_min_dist_per_key_join", f"""{_pairs_sql()},
ranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs),
near AS (SELECT * FROM ranked WHERE rank <= 60)
SELECT n.query_id, d.source, round(min(1 - n.score), 4) AS dist, count(*) AS hits
FROM near n JOIN documents d ON d.doc_id = n.id
GROUP BY 1, 2 HAVING 1 - min(1 - n.score) > 0.05""")
def vec_min_dist_per_key_join(t):
    near = nearest.search(_corpus(t), _questions(t), 60)
    docs = t.documents.select(F.col("doc_id").alias("id"), "source")
    best = near.join(docs, "id").groupBy("query_id", "source").agg(
        F.min(1 - F.col("score")).alias("d"), F.count("*").alias("hits"))
    return best.filter(1 - F.col("d") > 0.05).select("query_id", "source", F.round("d", 4).alias("dist"), "hits")


@query("vec_pairwise_matrix", f"""WITH {PROTOTYPES_SQL}
SELECT a.query_id AS query_id, b.query_id AS id, round(list_cosine_similarity(a.q, b.q), 4) + 0.0 AS score
FROM proto a, proto b""")
def vec_pairwise_matrix(t):
    q = _questions(t)
    return nearest.similarity_matrix(q.withColumnRenamed("query_id", "id"), q)


@query("relevance_gate", f"""{_topk_sql('cosine', 4).replace('SELECT query_id, id, score, rank FROM ranked WHERE rank <= 4',
'''SELECT query_id, max(score) AS best, CASE WHEN max(score) >= 0.35 THEN 'answer' ELSE 'fallback' END AS decision
FROM ranked WHERE rank <= 4 GROUP BY query_id''')}""")
def relevance_gate(t):
    return fusion.gate(nearest.search(_corpus(t), _questions(t), 4), 0.35)


@query("source_selection_85", f"""{_topk_sql('cosine', 40).replace('SELECT query_id, id, score, rank FROM ranked WHERE rank <= 40', '''
, hits AS (SELECT r.*, d.source FROM ranked r JOIN documents d ON d.doc_id = r.id WHERE rank <= 40),
per AS (SELECT query_id, source, max(score) AS score FROM hits GROUP BY 1, 2)
SELECT query_id, source, score FROM per p
WHERE score >= (SELECT max(score) FROM per q WHERE q.query_id = p.query_id) * 0.85''')}""")
def source_selection_85(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "source")
    hits = nearest.search(_corpus(t), _questions(t), 40).join(docs, "id")
    return fusion.select_sources(hits)


# --- names ------------------------------------------------------------------------

TRIGRAM_SETS_SQL = """
grams(txt) AS (SELECT NULL::VARCHAR WHERE false)"""


def _tri_sql(source: str) -> str:
    """(txt, gs): word-trigram set of each distinct text of `source`."""
    return f"""(SELECT txt, list_distinct(flatten(list_transform(
        list_filter(regexp_split_to_array(lower(txt), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''),
        lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS gs
      FROM (SELECT DISTINCT txt FROM {source}))"""


PART_QUESTIONS = "(SELECT lower(p_type) || ' ' || split_part(p_name, ' ', 2) AS txt FROM part)"
SIM_SQL = "round(len(list_intersect(q.gs, n.gs)) / len(list_distinct(list_concat(q.gs, n.gs))), 6)"


def _part_questions(t):
    return t.part.select(F.concat(F.lower("p_type"), F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("text")).distinct()


@query("trgm_name_lookup", f"""WITH q AS {_tri_sql(PART_QUESTIONS)}, n AS {_tri_sql('(SELECT p_name AS txt FROM part)')},
pairs AS (SELECT q.txt AS question, n.txt AS name, {SIM_SQL} AS sim FROM q, n),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY sim DESC, name) AS rank FROM pairs WHERE sim >= 0.35)
SELECT question, name, sim, rank FROM ranked WHERE rank <= 3""")
def trgm_name_lookup(t):
    return setjoin.name_lookup(_part_questions(t), t.part.select(F.col("p_name").alias("text")).distinct(), 0.35, 3)


CATALOG_SQL = """(SELECT p_name AS txt, 'part' AS entity FROM part UNION SELECT p_brand, 'brand' FROM part
 UNION SELECT p_type, 'type' FROM part UNION SELECT n_name, 'nation' FROM nation UNION SELECT r_name, 'region' FROM region
 UNION SELECT c_mktsegment, 'segment' FROM customer UNION SELECT o_orderpriority, 'priority' FROM orders)"""
WORDS_SQL = "(SELECT unnest(string_split(p_name, ' ')) AS txt FROM part)"


@query("trgm_multi_entity", f"""WITH q AS {_tri_sql(WORDS_SQL)}, n AS {_tri_sql(CATALOG_SQL)}, cat AS {CATALOG_SQL},
pairs AS (SELECT q.txt AS question, cat.entity, n.txt AS name, {SIM_SQL} AS sim
          FROM q, n JOIN cat ON cat.txt = n.txt
          WHERE {SIM_SQL} > 0.15 OR contains(strip_accents(lower(n.txt)), strip_accents(lower(q.txt)))),
branch AS (SELECT *, row_number() OVER (PARTITION BY question, entity ORDER BY sim DESC, name) AS b FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY sim DESC, entity, name) AS rank FROM branch WHERE b <= 6)
SELECT question, entity, name, sim, rank FROM ranked WHERE rank <= 6""")
def trgm_multi_entity(t):
    named = [(t.part, "p_name", "part"), (t.part, "p_brand", "brand"), (t.part, "p_type", "type"),
             (t.nation, "n_name", "nation"), (t.region, "r_name", "region"),
             (t.customer, "c_mktsegment", "segment"), (t.orders, "o_orderpriority", "priority")]
    catalog = None
    for df, c, entity in named:
        part = df.select(F.col(c).alias("text"), F.lit(entity).alias("entity")).distinct()
        catalog = part if catalog is None else catalog.unionByName(part)
    asked = t.part.select(F.explode(F.split("p_name", " ")).alias("text")).distinct()
    return setjoin.entity_lookup(asked, catalog, 0.15, 6)


@query("trgm_near_tie_pref", f"""WITH q AS {_tri_sql(PART_QUESTIONS)}, n AS {_tri_sql('(SELECT p_name AS txt FROM part)')},
pairs AS (SELECT q.txt AS question, n.txt AS name, {SIM_SQL} AS sim FROM q, n),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY sim DESC, name) AS rank FROM pairs WHERE sim > 0.3) WHERE rank <= 5),
flag AS (SELECT *, (sim >= max(sim) OVER (PARTITION BY question) - 0.05 - 1e-12) AND name LIKE '%e%' AS preferred FROM top)
SELECT question, name, sim, preferred FROM (
  SELECT *, row_number() OVER (PARTITION BY question ORDER BY preferred DESC, sim DESC, name) AS r FROM flag) WHERE r = 1""")
def trgm_near_tie_pref(t):
    found = setjoin.name_lookup(_part_questions(t), t.part.select(F.col("p_name").alias("text")).distinct(), 0.3, 5,
                                strict=True)
    return setjoin.near_tie_preference(found, F.col("name").contains("e"))


@query("trgm_whole_string", """
WITH s AS (SELECT DISTINCT lower(trim(p_type)) || ' ' || p_name AS txt FROM part),
g AS (SELECT txt, list_distinct(list_transform(range(1, length(txt) + 3), lambda i: substr('  ' || txt || '  ', i, 3))) AS gs FROM s)
SELECT a.txt AS left_id, b.txt AS right_id,
       round(len(list_intersect(a.gs, b.gs)) / len(list_distinct(list_concat(a.gs, b.gs))), 6) AS sim
FROM g a, g b WHERE a.txt < b.txt
AND len(list_intersect(a.gs, b.gs)) / len(list_distinct(list_concat(a.gs, b.gs))) >= 0.6""")
def trgm_whole_string(t):
    names = t.part.select(T.question_key(F.concat(F.col("p_type"), F.lit(" "), F.col("p_name"))).alias("id")).distinct()
    sets = names.select("id", T.string_trigrams("id").alias("tokens"))
    return setjoin.jaccard_join(sets, sets, 0.6, once=True)


# --- lexical and hybrid -------------------------------------------------------------


def _docs(t):
    return t.documents.select(F.col("doc_id").alias("id"), "text")


def _asked(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def _bm25_sql(tokenizer: str) -> str:
    return f"""
d AS (SELECT doc_id AS id, {tokenizer.format('text')} AS toks FROM documents),
tf AS (SELECT id, tok, count(*) AS f FROM (SELECT id, unnest(toks) AS tok FROM d) GROUP BY 1, 2),
dl AS (SELECT id, len(toks) AS n FROM d),
st AS (SELECT count(*) AS n_docs, avg(n) AS avg_len FROM dl),
df AS (SELECT tok, count(*) AS n FROM tf GROUP BY 1),
raw AS (SELECT tok, ln(n_docs - n + 0.5) - ln(n + 0.5) AS w FROM df, st),
idf AS (SELECT tok, CASE WHEN w < 0 THEN 0.25 * (SELECT avg(w) FROM raw) ELSE w END AS w FROM raw),
qt AS (SELECT item_id AS query_id, tok, count(*) AS m FROM (SELECT item_id, unnest({tokenizer.format('text')}) AS tok FROM benchmark) GROUP BY 1, 2),
lex0 AS (SELECT qt.query_id, tf.id, sum(qt.m * idf.w * tf.f * 2.5 / (tf.f + 1.5 * (0.25 + 0.75 * dl.n / st.avg_len))) AS s
        FROM qt JOIN tf USING (tok) JOIN idf USING (tok) JOIN dl ON dl.id = tf.id, st GROUP BY 1, 2),
lex AS (SELECT b.item_id AS query_id, d.id, coalesce(s, 0.0) AS s FROM benchmark b CROSS JOIN d
        LEFT JOIN lex0 ON lex0.query_id = b.item_id AND lex0.id = d.id)"""


SPLIT_WS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
SPLIT_ALNUM = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query("bm25_topk", f"""WITH {_bm25_sql(SPLIT_WS)},
ranked AS (SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS rank FROM lex)
SELECT query_id, id, score, rank FROM ranked WHERE rank <= 5""")
def bm25_topk(t):
    return lexical.search(_docs(t), _asked(t), 5)


def _embed_sql(name: str, source: str, key: str) -> str:
    """Unit bag-of-words vectors in 64 hashed slots, as (key, i, x)."""
    return f"""
{name}_slots AS (SELECT {key}, slot, count(*)::DOUBLE AS c FROM (
   SELECT {key}, ((instr('0123456789abcdef', md5(tok)[1]) - 1) * 16 + instr('0123456789abcdef', md5(tok)[2]) - 1) % 64 AS slot
   FROM (SELECT {key}, unnest({SPLIT_ALNUM.format('text')}) AS tok FROM {source})) GROUP BY 1, 2),
{name} AS (SELECT {key}, slot, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS x FROM {name}_slots)"""


HASH_SEM_SQL = f"""{_embed_sql('dv', '(SELECT doc_id AS id, text FROM documents)', 'id')},
{_embed_sql('qv', '(SELECT item_id AS query_id, text FROM benchmark)', 'query_id')},
dot AS (SELECT q.query_id, d.id, sum(q.x * d.x) AS s FROM qv q JOIN dv d USING (slot) GROUP BY 1, 2),
sem AS (SELECT b.item_id AS query_id, d.doc_id AS id, coalesce(s, 0.0) AS s FROM benchmark b CROSS JOIN documents d
        LEFT JOIN dot ON dot.query_id = b.item_id AND dot.id = d.doc_id)"""


@query("hash_embedding_topk", f"""WITH {HASH_SEM_SQL},
ranked AS (SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS rank FROM sem)
SELECT query_id, id, score, rank FROM ranked WHERE rank <= 5""")
def hash_embedding_topk(t):
    from ..functions import embed
    return nearest.search(embed.embed(_docs(t), "text"), embed.embed(_asked(t), "text", key="query_id"), 5, digits=6)


@query("hybrid_rrf", f"""WITH {_bm25_sql(SPLIT_WS)}, {HASH_SEM_SQL},
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS rank FROM lex
      UNION ALL
      SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS rank FROM sem),
fused AS (SELECT query_id, id, round(sum(0.5 / (60 + rank)), 6) AS score FROM r WHERE rank <= 5 GROUP BY 1, 2)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused""")
def hybrid_rrf(t):
    return fusion.hybrid(_docs(t), _asked(t), alpha=0.5, k=5)


@query("hybrid_linear", f"""WITH {_bm25_sql(SPLIT_ALNUM)}, {HASH_SEM_SQL},
both_s AS (SELECT lex.query_id, lex.id, lex.s AS l, sem.s AS v FROM lex JOIN sem USING (query_id, id)),
scaled AS (SELECT query_id, id, 0.5 * (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-8)
        + 0.5 * l / CASE WHEN max(l) OVER w = 0 THEN 1 ELSE max(l) OVER w END AS s FROM both_s WINDOW w AS (PARTITION BY query_id)),
ranked AS (SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS rank FROM scaled)
SELECT query_id, id, score, rank FROM ranked WHERE rank <= 3""")
def hybrid_linear(t):
    return fusion.linear_hybrid(_docs(t), _asked(t), alpha=0.5, k=3)


@query("rerank_overlap", f"""WITH {_bm25_sql(SPLIT_WS)},
ranked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS rank FROM lex),
cand AS (SELECT r.*, list_distinct({SPLIT_ALNUM.format('b.text')}) AS q, list_distinct({SPLIT_ALNUM.format('x.text')}) AS dt
         FROM ranked r JOIN benchmark b ON b.item_id = r.query_id JOIN documents x ON x.doc_id = r.id WHERE rank <= 10),
scored AS (SELECT query_id, id, rank, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, dt)) / len(q) END, 4) AS rerank_score FROM cand)
SELECT * FROM (SELECT query_id, id, rank, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS new_rank FROM scored)
WHERE new_rank <= 3""")
def rerank_overlap(t):
    found = lexical.search(_docs(t), _asked(t), 10).drop("score")
    cand = (found.join(_asked(t).withColumnRenamed("text", "question"), "query_id")
            .join(_docs(t).withColumnRenamed("text", "body"), "id"))
    out = fusion.rerank(cand, lexical.overlap("question", "body"), 3)
    return out.select("query_id", "id", "rank", "rerank_score", "new_rank")


@query("keyword_multi_search", f"""WITH kw AS (SELECT DISTINCT item_id AS kw_id, item_id, text FROM benchmark),
{_bm25_sql(SPLIT_WS)},
ranked AS (SELECT query_id AS kw_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS rank FROM lex),
cand AS (SELECT r.*, left(x.text, 150) AS prefix FROM ranked r JOIN documents x ON x.doc_id = r.id WHERE rank <= 3),
seen AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY kw_id, rank) AS o FROM cand)
SELECT id, score, kw_id FROM seen WHERE o = 1 ORDER BY score DESC, id LIMIT 20""")
def keyword_multi_search(t):
    found = lexical.search(_docs(t), _asked(t), nearest.keyword_k(20, 40))
    cand = found.join(_docs(t), "id")
    kept = fusion.first_seen_per_prefix(cand, "text", [F.col("query_id"), F.col("rank")], 20)
    return kept.select("id", "score", F.col("query_id").alias("kw_id"))


@query("citation_match", f"""WITH {_bm25_sql(SPLIT_WS)},
ranked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS rank FROM lex),
cand AS (SELECT r.query_id, r.id, lower(x.text) AS answer,
   list_filter({SPLIT_WS.format("lower(b.text)")}, lambda w: length(w) > 3) AS ws
   FROM ranked r JOIN benchmark b ON b.item_id = r.query_id JOIN documents x ON x.doc_id = r.id WHERE rank <= 5)
SELECT query_id, id FROM cand WHERE len(ws) > 0
AND len(list_filter(ws, lambda w: contains(answer, w))) >= greatest(1, len(ws) // 2)""")
def citation_match(t):
    found = lexical.search(_docs(t), _asked(t), 5).select("query_id", "id")
    # The documents stand for answers, the passages for the titles that they may cite.
    cand = (found.join(_asked(t).withColumnRenamed("text", "title"), "query_id")
            .join(_docs(t).withColumnRenamed("text", "answer"), "id"))
    return cand.filter(fusion.cites("answer", "title")).select("query_id", "id")
