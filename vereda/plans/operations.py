"""Event-log metrics, response cache, paging and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import session
from ..functions import embed, rules as R, text as T
from ..operators import evaluate, lexical, nearest, reliability, respcache
from . import context
from .registry import query
from .retrieval import CORPUS_SQL, HASH_SEM_SQL, PROTOTYPES_SQL, SPLIT_WS, _asked, _bm25_sql, _corpus, _docs, _questions

# --- events as a component log: errors fail, signups are fallbacks ---------------------

LOG_SQL = """log AS (SELECT event_id, ts, epoch_us(ts) / 1e6 AS s, 'c' || (user_id % 5) AS component, value AS elapsed_ms,
 CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'fallback' ELSE 'success' END AS event FROM events)"""

OUTAGE_SQL = f"""{LOG_SQL},
req AS (SELECT *, lag(event) OVER (PARTITION BY component ORDER BY ts, event_id) AS before,
  sum((event = 'success')::INT) OVER (PARTITION BY component ORDER BY ts, event_id) AS island FROM log WHERE event <> 'fallback'),
isl AS (SELECT component, island, min(s) FILTER (WHERE event = 'failure') AS f0 FROM req GROUP BY 1, 2),
closed AS (SELECT i.component, i.f0, r.s AS t1 FROM isl i LEFT JOIN req r ON r.component = i.component AND r.island = i.island + 1 AND r.event = 'success' WHERE f0 IS NOT NULL)"""


def component_log(t):
    event = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "signup", "fallback").otherwise("success")
    return t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                           F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("component"),
                           F.col("value").alias("elapsed_ms"), event.alias("event"))


@query("ops_summary", f"""WITH {LOG_SQL}
SELECT component, count(*) FILTER (WHERE event <> 'fallback') AS requests, count(*) FILTER (WHERE event = 'failure') AS failures,
 count(*) FILTER (WHERE event = 'fallback') AS fallbacks, round(avg(elapsed_ms) FILTER (WHERE event <> 'fallback'), 4) AS avg_latency_ms,
 round(count(*) FILTER (WHERE event = 'success') / count(*) FILTER (WHERE event <> 'fallback'), 6) AS success_rate,
 round(1 - count(*) FILTER (WHERE event = 'success') / count(*) FILTER (WHERE event <> 'fallback'), 6) AS failure_rate FROM log GROUP BY 1""")
def ops_summary(t):
    return reliability.summary(component_log(t))


@query("ops_mtbf", f"""WITH {LOG_SQL},
g AS (SELECT component, s - lag(s) OVER (PARTITION BY component ORDER BY ts, event_id) AS gap FROM log WHERE event = 'failure')
SELECT component, count(*) AS failures, round(avg(gap), 4) AS mtbf_s FROM g GROUP BY 1""")
def ops_mtbf(t):
    return reliability.mtbf(component_log(t))


@query("ops_mttr", f"""WITH {OUTAGE_SQL}
SELECT component, count(t1) AS outages, round(avg(t1 - f0), 4) AS mttr_s FROM closed GROUP BY 1""")
def ops_mttr(t):
    return reliability.mttr(component_log(t))


NOW = 1706745600  # 2024-02-01 00:00:00 UTC, after the last event


@query("ops_availability", f"""WITH {OUTAGE_SQL},
d AS (SELECT component, sum(coalesce(t1, {NOW}) - f0) AS down, min(f0) AS first FROM closed GROUP BY 1)
SELECT component, round(CASE WHEN down = 0 THEN 1.0 ELSE greatest(0.0, 1 - down / ({NOW} - first)) END, 6) AS availability FROM d""")
def ops_availability(t):
    return reliability.availability(component_log(t), F.lit(float(NOW)))


@query("ops_inter_arrival", f"""WITH {LOG_SQL}
SELECT event_id, round(s - lag(s) OVER (PARTITION BY component ORDER BY ts, event_id), 4) AS gap FROM log WHERE event = 'failure'""")
def ops_inter_arrival(t):
    from ..operators import scan
    failed = component_log(t).filter(F.col("event") == "failure").withColumn("s", reliability.seconds(F.col("ts")))
    prev = scan.previous(failed, ["component"], ["ts", "event_id"], F.col("s"), "before", F.date_trunc("hour", "ts"))
    return prev.select("event_id", F.round(F.col("s") - F.col("before"), 4).alias("gap"))


# --- response cache: document i asks its own text at second 30 i -----------------------

REQ_SQL = """req AS (SELECT doc_id AS id, doc_id * 30 AS sec,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '[?!.,;]$', ''), '^\\s+|\\s+$', '', 'g') AS q FROM documents)"""
ENTRY_SQL = f"""{REQ_SQL}, step AS (SELECT q, min(sec) AS sec FROM req GROUP BY q),
ent AS (SELECT q, sec AS created FROM step UNION ALL
 SELECT e.q, n.sec FROM ent e JOIN LATERAL (SELECT min(sec) AS sec FROM req r WHERE r.q = e.q AND r.sec > e.created + 3600) n ON true WHERE n.sec IS NOT NULL),
ents AS (SELECT sha256(q) AS key, q, created, coalesce(lead(created) OVER (PARTITION BY q ORDER BY created), 1e18) AS nxt FROM ent)"""


def _requests(t):
    return respcache.keyed(t.documents.select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") * 30).alias("sec")), "text").drop("text")


@query("cache_exact", f"""WITH RECURSIVE {ENTRY_SQL}
SELECT key, created, count(r.id) - 1 AS hits FROM ents e JOIN req r ON r.q = e.q AND r.sec >= e.created AND r.sec < e.nxt GROUP BY 1, 2""")
def cache_exact(t):
    return respcache.exact_entries(_requests(t))


@query("cache_stats", f"""WITH RECURSIVE {ENTRY_SQL}
SELECT count(DISTINCT q) AS entries, (SELECT count(*) FROM req) - count(*) AS hits, count(*) AS misses,
 round(((SELECT count(*) FROM req) - count(*)) / (SELECT count(*) FROM req), 6) AS hit_rate FROM ents""")
def cache_stats(t):
    return respcache.stats(respcache.exact_entries(_requests(t)))


@query("cache_evict", f"""WITH RECURSIVE {ENTRY_SQL}, m AS (SELECT max(sec) AS now FROM req),
newest AS (SELECT key, max(created) AS created FROM ents GROUP BY 1)
SELECT key, created FROM newest, m WHERE now - created <= 3600 ORDER BY created DESC, key LIMIT 512""")
def cache_evict(t):
    req = _requests(t)
    now = req.agg(F.max("sec")).first()[0]
    newest = respcache.exact_entries(req).groupBy("key").agg(F.max("created").alias("created"))
    return respcache.evict(newest, now)


KEY_SQL = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), "
           "'[?!.,;]$', ''), '^\\s+|\\s+$', '', 'g')")
GRAMS_SQL = "list_distinct(list_transform(range(1, length({0}) + 3), lambda i: substr('  ' || {0} || '  ', i, 3)))"

# Entries are the users' questions; requests repeat them a minute later without
# their first word.
FUZZY_SQL = f"""u AS (SELECT conv_id || '-' || turn AS id, conv_id * 30 + turn AS sec, text FROM conversations WHERE role = 'user'),
ent AS (SELECT q, min(sec) AS created, {GRAMS_SQL.format('q')} AS gs FROM (SELECT {KEY_SQL.format('text')} AS q, sec FROM u) GROUP BY q),
req AS (SELECT id, sec + 60 AS sec, q, {GRAMS_SQL.format('q')} AS gs FROM (SELECT id, sec, {KEY_SQL.format("regexp_replace(text, '^[^ ]* *', '')")} AS q FROM u)),
s AS (SELECT r.id, e.created, e.q AS entry, len(list_intersect(r.gs, e.gs)) / len(list_distinct(list_concat(r.gs, e.gs))) AS sim
  FROM req r JOIN ent e ON r.sec - e.created BETWEEN 0 AND 3600 AND least(len(r.gs), len(e.gs)) >= 0.8 * greatest(len(r.gs), len(e.gs))),
hit AS (SELECT id, created, entry, round(sim, 6) AS sim, row_number() OVER (PARTITION BY id ORDER BY created, entry) AS k FROM s WHERE sim >= 0.82)"""


@query("cache_fuzzy", f"WITH {FUZZY_SQL} SELECT id, created, sha256(entry) AS entry, sim FROM hit WHERE k = 1")
def cache_fuzzy(t):
    # Stored, as it is read three times and few tasks read the file.
    asked = session.checkpoint(session.deal(t.conversations, "conv_id").filter(F.col("role") == "user").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), (F.col("conv_id") * 30 + F.col("turn")).alias("sec"), "text"))
    # Read three times too.
    entries = session.checkpoint(asked.select(T.question_key("text").alias("question"), "sec").groupBy("question")
                                 .agg(F.min("sec").alias("created")))
    requests = asked.select("id", (F.col("sec") + 60).alias("sec"),
                            T.question_key(F.regexp_replace("text", "^[^ ]* *", "")).alias("question"))
    return respcache.lookup_fuzzy(requests, entries).withColumn("entry", F.sha2("entry", 256))


@query("page_results", f"""WITH {PROTOTYPES_SQL}, {CORPUS_SQL},
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(e, q), 4) DESC, id) AS rank FROM corpus, proto),
k AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM r WHERE rank <= 40)
SELECT query_id, id, rank, (rank - 1) // 4 AS page, greatest(0, n - ((rank - 1) // 4 + 1) * 4) AS remaining FROM k""")
def page_results(t):
    return respcache.pages(nearest.search(_corpus(t), _questions(t), 40).drop("score"))


@query("paging_sessions", """
WITH s AS (SELECT 's' || user_id AS session_id, max(floor(epoch(ts) / 40))::BIGINT AS created FROM events GROUP BY 1), m AS (SELECT max(created) AS now FROM s)
SELECT session_id, created FROM s, m WHERE now - created <= 1800 ORDER BY created DESC, session_id LIMIT 255""")
def paging_sessions(t):
    s = t.events.groupBy(F.concat(F.lit("s"), "user_id").alias("session_id")).agg(
        # The events are sparse: their clock runs 40 times as fast as that of the sessions they stand for.
        F.max(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 40)).alias("created"))
    now = s.agg(F.max("created")).first()[0]
    return respcache.live_sessions(s, now)


# --- evaluation --------------------------------------------------------------------------

RANKED_SQL = f"""{_bm25_sql(SPLIT_WS)},
ranked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS rank FROM lex),
top AS (SELECT r.query_id, r.id, r.rank, (contains(lower(x.text), lower(b.text)) OR contains(lower(b.text), lower(x.text))) AS hit
  FROM ranked r JOIN benchmark b ON b.item_id = r.query_id JOIN documents x ON x.doc_id = r.id WHERE rank <= 5)"""
MRR_SQL = """per AS (SELECT query_id, min(rank) FILTER (WHERE hit) AS first, count(*) FILTER (WHERE hit) AS hits, count(*) AS n FROM top GROUP BY 1)
SELECT round(avg(coalesce(1 / first, 0.0)), 4) AS mrr, round(avg((hits > 0)::INT), 4) AS recall_at_k, round(avg(hits / n), 4) AS precision_at_k,
 count(*) AS n_queries, 5 AS k FROM per"""


def _with_texts(found, t):
    return (found.join(_asked(t).withColumnRenamed("text", "asked"), "query_id")
            .join(_docs(t).withColumnRenamed("text", "found"), "id"))


@query("eval_mrr", f"WITH {RANKED_SQL}, {MRR_SQL}")
def eval_mrr(t):
    found = _with_texts(lexical.search(_docs(t), _asked(t), 5), t)
    return evaluate.mrr(found, _asked(t), evaluate.text_hit("asked", "found"), 5)


@query("eval_recall_precision", f"""WITH {PROTOTYPES_SQL}, {CORPUS_SQL},
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(e, q), 4) DESC, id) AS rank FROM corpus, proto),
rel AS (SELECT e.label AS query_id, e.vec_id AS id FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id WHERE l.quality = 1),
h AS (SELECT r.query_id, count(*) AS hits FROM r JOIN rel USING (query_id, id) WHERE rank <= 10 GROUP BY 1)
SELECT p.query_id, coalesce(hits, 0) AS hits, coalesce(n, 0) AS relevant, round(CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE coalesce(hits, 0) / n END, 4) AS recall,
 round(coalesce(hits, 0) / 10, 4) AS precision FROM proto p LEFT JOIN h USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM rel GROUP BY 1) USING (query_id)""")
def eval_recall_precision(t):
    found = nearest.search(_corpus(t), _questions(t), 10)
    good = t.labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("id"))
    relevant = _corpus(t).join(good, "id", "left_semi").select(F.col("label").alias("query_id"), "id")
    return evaluate.recall_precision(found, relevant, 10)


@query("eval_compare_configs", f"""WITH {_bm25_sql(SPLIT_WS)}, {HASH_SEM_SQL},
r AS (SELECT 'bm25' AS config, query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS rank FROM lex
 UNION ALL SELECT 'vector', query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) FROM sem),
top AS (SELECT r.*, (contains(lower(x.text), lower(b.text)) OR contains(lower(b.text), lower(x.text))) AS hit
  FROM r JOIN benchmark b ON b.item_id = r.query_id JOIN documents x ON x.doc_id = r.id WHERE rank <= 5),
per AS (SELECT config, query_id, min(rank) FILTER (WHERE hit) AS first, count(*) FILTER (WHERE hit) AS hits, count(*) AS n FROM top GROUP BY 1, 2)
SELECT config, round(avg(coalesce(1 / first, 0.0)), 4) AS mrr, round(avg((hits > 0)::INT), 4) AS recall_at_k, round(avg(hits / n), 4) AS precision_at_k FROM per GROUP BY 1""")
def eval_compare_configs(t):
    runs = {"bm25": lexical.search(_docs(t), _asked(t), 5),
            "vector": nearest.search(embed.embed(_docs(t), "text"), embed.embed(_asked(t), "text", key="query_id"), 5, digits=6)}
    out = None
    for name, found in runs.items():
        row = evaluate.mrr(_with_texts(found, t), _asked(t), evaluate.text_hit("asked", "found"), 5).select(
            F.lit(name).alias("config"), "mrr", "recall_at_k", "precision_at_k")
        out = row if out is None else out.unionByName(row)
    return out


@query("eval_rouge_l")
def eval_rouge_l(t):
    best = _with_texts(lexical.search(_docs(t), _asked(t), 1), t)
    return evaluate.rouge_l(best, "found", "asked").select("query_id", "id", "rouge_p", "rouge_r", "rouge_f1")


@query("eval_embedding_score", f"""WITH {_bm25_sql(SPLIT_WS)}, {HASH_SEM_SQL},
best AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS r FROM lex) WHERE r = 1)
SELECT round(avg(s), 4) AS f1_mean, round(min(s), 4) AS f1_min, round(max(s), 4) AS f1_max FROM best JOIN sem USING (query_id, id)""")
def eval_embedding_score(t):
    best = lexical.search(_docs(t), _asked(t), 1).select("query_id", "id")
    dv = embed.embed(_docs(t), "text").withColumnRenamed("embedding", "d")
    qv = embed.embed(_asked(t), "text", key="query_id").withColumnRenamed("embedding", "q")
    return evaluate.embedding_score(best.join(dv, "id").join(qv, "query_id"), "d", "q")


@query("eval_content_check", """
WITH s AS (SELECT conv_id, turn, text, trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g')) AS a FROM conversations)
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN contains(a, 'the') AND (contains(a, 'tion') OR contains(a, 'eree')) WHEN 1 THEN contains(a, 'ee') END AS content_ok,
 CASE WHEN turn % 2 = 0 THEN list_has_any(regexp_split_to_array(text, '\\s+'), ['the', 'and']) END AS tool_ok FROM s""")
def eval_content_check(t):
    must_all = F.when(F.col("turn") % 3 == 0, F.array(F.lit("THE"))).when(F.col("turn") % 3 == 1, F.array(F.lit("éé")))
    must_any = F.when(F.col("turn") % 3 == 0, F.array(F.lit("tíon"), F.lit("érée")))
    # The words of the turn stand for the tools that it used.
    used, expected = T.words("text"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("the"), F.lit("and")))
    return t.conversations.select("conv_id", "turn", evaluate.content_ok("text", must_all, must_any).alias("content_ok"),
                                  evaluate.tools_ok(used, expected).alias("tool_ok"))


@query("eval_judge_parse", r"""
WITH k AS (SELECT doc_id, length(text) % 14 AS k, doc_id % 3 AS i, translate(text, '{}', '()') AS text FROM documents)
SELECT doc_id, CASE WHEN i < 2 THEN least(k, 10)::INT END AS fidelidade, CASE WHEN i = 0 THEN 7::INT END AS relevancia,
 CASE i WHEN 0 THEN text WHEN 1 THEN nullif(regexp_extract(replace(text, '"', '\"'), '^[^"]*'), '') END AS why FROM k""")
def eval_judge_parse(t):
    text, k, kind = F.translate("text", "{}", "()"), F.length("text") % 14, F.col("doc_id") % 3
    whole = F.concat(F.lit("Segue: "), F.to_json(F.struct(
        k.alias("fidelidade"), F.lit("7").alias("relevancia"), F.lit(None).cast("string").alias("completude"), text.alias("justificativa"))))
    # A reply that breaks off inside the text.
    cut = F.concat(F.format_string('{"fidelidade": %d, "justificativa": "', k), F.replace(text, F.lit('"'), F.lit('\\"')))
    reply = F.when(kind == 0, whole).when(kind == 1, cut).otherwise(F.concat(F.lit("sem nota: "), text))
    return t.documents.select("doc_id", evaluate.judge(reply).alias("j")).select(
        "doc_id", F.col("j.fidelidade").alias("fidelidade"), F.col("j.relevancia").alias("relevancia"),
        F.col("j.justificativa").alias("why"))


@query("eval_batch_report", """
WITH s AS (SELECT *, trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g')) AS a FROM conversations)
SELECT role, count(*) AS items, round(avg(CASE WHEN turn % 3 = 0 THEN contains(a, 'the')::INT END), 4) AS content_ok FROM s GROUP BY 1""")
def eval_batch_report(t):
    must = F.when(F.col("turn") % 3 == 0, F.array(F.lit("the")))
    s = t.conversations.select("role", evaluate.content_ok("text", must, F.lit(None).cast("array<string>")).alias("ok"))
    return s.groupBy("role").agg(F.count("*").alias("items"), F.round(F.avg(F.col("ok").cast("int")), 4).alias("content_ok"))


# --- context and answers -------------------------------------------------------------------


@query("context_assembly", f"""WITH {_bm25_sql(SPLIT_WS)},
ranked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, id) AS rank FROM lex),
top AS (SELECT r.*, x.source, x.lang, CASE WHEN length(x.text) > 1500 THEN left(x.text, 1500) || '…' ELSE x.text END AS body FROM ranked r JOIN documents x ON x.doc_id = r.id WHERE rank <= 4),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1 AS lead FROM top)
SELECT query_id, string_agg('[Título: ' || lang || ' | Fonte: ' || source || ']' || chr(10) || body || CASE WHEN lead THEN chr(10) || chr(10) || '[Dados completos do documento]' || chr(10) || '{{"source":"' || source || '"}}' ELSE '' END,
 chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM f GROUP BY 1""")
def context_assembly(t):
    found = lexical.search(_docs(t), _asked(t), 4).select("query_id", "id", "rank")
    rows = found.join(t.documents.select(F.col("doc_id").alias("id"), "text", "source", "lang"), "id")
    record = F.to_json(F.struct("source"))
    return context.assemble(rows, title=F.col("lang"), source=F.col("source"), content=F.col("text"),
                            doc_key="source", record=record, max_chars=1500)


@query("answer_cascade")
def answer_cascade(t):
    from . import answer
    asked = t.conversations.filter(F.col("role") == "user").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").alias("sec"), "text")
    return answer.plan(asked)
