"""Text cleaning, rules, guards, chunking and HTML over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import rules as R
from ..functions import text as T
from ..operators import chunk as C
from .registry import query

NORM = "strip_accents(lower({0}))"
WS_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def case_sql(target: str, rules, default: str | None = None) -> str:
    body = " ".join(f"WHEN regexp_matches({target}, {lit(p)}) THEN {lit(label)}" for label, p in rules)
    tail = f" ELSE {lit(default)}" if default else ""
    return f"CASE {body}{tail} END"


def any_sql(target: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({target}, {lit(p)})" for p in patterns) + ")"


# --- cleaning ---------------------------------------------------------------------

CLEAN_SQL = ("nullif(" + WS_STRIP.format(
    "regexp_replace(regexp_replace(replace(nfc_normalize(text), chr(160), ' '), '[ \\t]+', ' ', 'g'), '[ \\t]*\\n[ \\t\\n]*', chr(10), 'g')"
) + ", '')")


@query("text_clean", f"SELECT doc_id, {CLEAN_SQL} AS clean FROM documents")
def text_clean(t):
    return t.documents.select("doc_id", T.clean("text").alias("clean"))


@query("text_tidy", """
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 replace(replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&amp;', '&'), chr(160), ' '), chr(8203), ''),
 '[ \\t]+', ' ', 'g'), '[ \\t]*\\n[ \\t]*', chr(10), 'g'), ' +([,.;:!?%)\\]])', '\\1', 'g'), '([(\\[]) +', '\\1', 'g'), '^\\s+|\\s+$', '', 'g') AS tidy
FROM documents""")
def text_tidy(t):
    return t.documents.select("doc_id", T.tidy("text").alias("tidy"))


@query("slugify", """
SELECT p_partkey AS id, CASE WHEN s = '' THEN 'sem_titulo' ELSE s END AS slug FROM (
 SELECT p_partkey, regexp_replace(regexp_replace(strip_accents(lower(p_name || ' / ' || p_brand)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM part)""")
def slugify(t):
    return t.part.select(F.col("p_partkey").alias("id"), T.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))


@query("unaccent_key", """
SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9 ]', '', 'g'), ' ') AS key FROM documents""")
def unaccent_key(t):
    return t.documents.select("doc_id", T.name_key("text").alias("key"))


@query("word_count", """
SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]+')) AS words,
 len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS blanks,
 len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS tokens FROM documents""")
def word_count(t):
    return t.documents.select("doc_id", T.word_count("text").alias("words"), F.size(T.words("text")).alias("blanks"),
                              F.size(T.tokens("text")).alias("tokens"))


@query("summary_text", """
WITH s AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
c AS (SELECT doc_id, t, left(t, 400) AS h FROM s),
k AS (SELECT *, greatest(CASE WHEN instr(reverse(h), ' .') = 0 THEN -1 ELSE length(h) - instr(reverse(h), ' .') - 1 END,
                         CASE WHEN instr(reverse(h), chr(10)) = 0 THEN -1 ELSE length(h) - instr(reverse(h), chr(10)) END) AS dot,
             CASE WHEN instr(reverse(h), ' ') = 0 THEN -1 ELSE length(h) - instr(reverse(h), ' ') END AS sp FROM c)
SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN length(t) <= 400 THEN t
  WHEN dot > 200 THEN regexp_replace(left(h, dot + 1), '^\\s+|\\s+$', '', 'g')
  WHEN sp >= 0 THEN regexp_replace(left(h, sp), '^\\s+|\\s+$', '', 'g') || '…' ELSE h || '…' END AS summary FROM k""")
def summary_text(t):
    return t.documents.select("doc_id", T.summary("text").alias("summary"))


@query("sentiment_rule", """
WITH s AS (SELECT doc_id, len(list_filter(['the', 'that', 'with'], lambda w: contains(lower(text), w))) AS p,
                  len(list_filter(['und', 'les', 'para', 'que'], lambda w: contains(lower(text), w))) AS n FROM documents)
SELECT doc_id, CASE WHEN p > n THEN 'Positivo' WHEN n > p THEN 'Negativo' ELSE 'Neutro' END AS mood FROM s""")
def sentiment_rule(t):
    return t.documents.select("doc_id", T.sentiment("text", ("the", "that", "with"), ("und", "les", "para", "que")).alias("mood"))


# --- dates and codes ----------------------------------------------------------------


@query("years_cited", """
SELECT o_orderkey, list_sort(list_distinct([y FOR y IN [year(o_orderdate), year(o_orderdate + INTERVAL 200 DAY)] IF y >= 2000])) AS years FROM orders""")
def years_cited(t):
    later = F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 200 DAYS"), "dd/MM/yyyy")
    said = F.concat(F.lit("de "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" a "), later)
    return t.orders.select("o_orderkey", T.cited_years(said).alias("years"))


@query("year_semester", """
SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN year(o_orderdate)::INT END AS year,
 CASE WHEN year(o_orderdate) >= 2000 AND o_orderstatus <> 'P' THEN CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END END AS semester FROM orders""")
def year_semester(t):
    half = F.when(F.month("o_orderdate") <= 6, "1").otherwise("2")
    slug = F.concat(F.lit("selecao-"), F.year("o_orderdate").cast("string"))
    titled = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("Oferta "), F.year("o_orderdate").cast("string"), F.lit(" / "), half))
    ys = T.year_semester(slug, titled)
    return t.orders.select("o_orderkey", ys["year"].alias("year"), ys["semester"].alias("semester"))


@query("date_long_pt", """
SELECT o_orderkey, day(o_orderdate) || ' de ' || ['janeiro','fevereiro','março','abril','maio','junho','julho','agosto','setembro','outubro','novembro','dezembro'][month(o_orderdate)]
 || ' de ' || year(o_orderdate) AS long_date, o_orderdate::DATE AS parsed FROM orders""")
def date_long_pt(t):
    long = T.long_date("o_orderdate")
    return t.orders.select("o_orderkey", long.alias("long_date"),
                           T.parse_long_date(F.concat(F.lit("Defesa, "), long, F.lit(", 14:00"))).alias("parsed"))


@query("semester_of", """
SELECT o_orderkey, CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS semester,
 ['SEG','TER','QUA','QUI','SEX','SAB','DOM'][isodow(o_orderdate)] AS weekday FROM orders""")
def semester_of(t):
    names = F.array(*[F.lit(x) for x in ("segunda-feira", "terça", "quarta", "quinta", "sexta", "Sábado", "domingo")])
    return t.orders.select("o_orderkey", T.semester_of("o_orderdate").alias("semester"),
                           T.weekday(F.element_at(names, F.weekday("o_orderdate") + 1)).alias("weekday"))


@query("parse_numbers", """
SELECT o_orderkey, o_orderkey % 100000 AS number, o_orderdate::DATE AS day,
 CASE WHEN o_custkey % 30 <= 23 THEN lpad((o_custkey % 30)::VARCHAR, 2, '0') || ':30' END AS at FROM orders""")
def parse_numbers(t):
    said = F.concat(F.lit("cerca de "), F.expr("format_number(o_orderkey % 100000, 0)"))
    dotted = F.replace(said, F.lit(","), F.lit("."))
    return t.orders.select(
        "o_orderkey", T.to_int(dotted).alias("number"),
        T.to_date_br(F.concat(F.lit("em "), F.date_format("o_orderdate", "dd/MM/yyyy"))).alias("day"),
        T.to_time(F.concat((F.col("o_custkey") % 30).cast("string"), F.lit(":30h"))).alias("at"))


@query("class_key", """
SELECT l_orderkey, l_linenumber, l_partkey || '-' || coalesce(CASE WHEN year(l_shipdate) >= 1998 THEN year(l_shipdate) END, 0) || '-' ||
 CASE WHEN month(l_shipdate) <= 6 THEN 1 ELSE 2 END || '-' || l_returnflag || l_linestatus AS class_id FROM lineitem""")
def class_key(t):
    year = F.when(F.year("l_shipdate") >= 1998, F.year("l_shipdate"))
    return t.lineitem.select("l_orderkey", "l_linenumber", T.class_key(
        F.col("l_partkey").cast("string"), year, T.semester_of("l_shipdate"),
        F.concat("l_returnflag", "l_linestatus")).alias("class_id"))


@query("curriculum_labels", """
SELECT p_partkey, CASE WHEN p_size <= 10 THEN p_size END AS semester,
 CASE WHEN p_type = 'PROMO' THEN 'optativas' WHEN p_type = 'ECONOMY' THEN 'complementares' ELSE 'semestre' END AS block FROM part""")
def curriculum_labels(t):
    label = (F.when(F.col("p_type") == "PROMO", "Optativas").when(F.col("p_type") == "ECONOMY", "Atividades Complementares")
             .otherwise("Semestre"))
    numbered = F.when(F.col("p_size") <= 10, F.concat(F.col("p_size").cast("string"), F.lit("º Semestre"))).otherwise(label)
    return t.part.select("p_partkey", T.semester_number(numbered).alias("semester"), T.curriculum_block(label).alias("block"))


@query("portal_href_ids", """
SELECT s_suppkey, s_suppkey::VARCHAR AS id, 'https://x.example/servidores/id/' || s_suppkey AS bare FROM supplier""")
def portal_href_ids(t):
    href = F.concat(F.lit("https://x.example/servidores/id/"), F.col("s_suppkey").cast("string"), F.lit("#topo"))
    return t.supplier.select("s_suppkey", T.href_id(href, "servidores").alias("id"), H.without_fragment(href).alias("bare"))


# --- presentation -----------------------------------------------------------------------


@query("snippet_around_term", """
WITH s AS (SELECT doc_id, text, instr(lower(text), 'the') AS a, instr(lower(text), 'die') AS b FROM documents),
k AS (SELECT *, CASE WHEN a > 0 THEN a ELSE b END AS hit FROM s)
SELECT doc_id, regexp_replace(CASE WHEN hit > 0 THEN substr(text, greatest(1, hit - 100), hit + 300 - greatest(1, hit - 100)) ELSE left(text, 250) END,
 '^\\s+|\\s+$', '', 'g') AS snippet, CASE WHEN length(text) > 300 THEN left(text, 300) || ' [...]' ELSE text END AS cell FROM k""")
def snippet_around_term(t):
    return t.documents.select("doc_id", T.snippet("text", ["the", "die"]).alias("snippet"), T.truncate("text", 300).alias("cell"))


@query("labelled_lines", """
SELECT o_orderkey, concat_ws(chr(10), 'Status: ' || o_orderstatus, CASE WHEN o_orderpriority <> '5-LOW' THEN 'Prioridade: ' || o_orderpriority END,
 'Data: ' || strftime(o_orderdate, '%Y-%m-%d')) AS card, replace(replace(o_orderpriority || '/x-y', '-', ' '), '/', ' › ') AS path,
 CASE o_orderstatus WHEN 'F' THEN 'Fechado' WHEN 'O' THEN 'Aberto' ELSE o_orderstatus END AS status FROM orders""")
def labelled_lines(t):
    return t.orders.select(
        "o_orderkey",
        T.join_lines(T.labelled("Status", "o_orderstatus"),
                     T.labelled("Prioridade", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))),
                     T.labelled("Data", F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("card"),
        T.readable_path(F.concat("o_orderpriority", F.lit("/x-y"))).alias("path"),
        T.display_label("o_orderstatus", {"F": "Fechado", "O": "Aberto"}).alias("status"))


@query("json_fields", """
SELECT event_id, json_extract_string(props, '$.k') AS k, contains(props, '"k": 1') AS k_starts_1 FROM events""")
def json_fields(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"),
                           F.contains("props", F.lit('"k": 1')).alias("k_starts_1"))


@query("lexical_any_term", """
SELECT doc_id, (contains(lower(text), 'thing') OR contains(lower(text), 'ciones')) AS hit,
 contains(strip_accents(lower(text)), 'etion') AS unaccented FROM documents""")
def lexical_any_term(t):
    return t.documents.select("doc_id", T.contains_any("text", ["the", "thing", "ciones"]).alias("hit"),
                              T.contains_unaccented("text", F.lit("étion")).alias("unaccented"))


# --- classification -----------------------------------------------------------------------

CLASSIFY_SQL = f"""
WITH s AS (SELECT doc_id, {NORM.format("text || ' ' || source")} AS n, {NORM.format("left(text, 600)")} AS h FROM documents)
SELECT doc_id, {case_sql('n', R.NOTICE_TYPE, 'outro')} AS notice, {case_sql('n', R.NOTICE_LEVEL)} AS level,
 {case_sql("'geral ' || h", R.POST_SUBJECT, 'geral')} AS subject FROM s"""


@query("rule_classify", CLASSIFY_SQL)
def rule_classify(t):
    docs = t.documents.withColumn("n", T.normalize(F.concat_ws(" ", "text", "source")))
    body = F.col("n")
    return docs.select("doc_id", R.first_match(body, R.NOTICE_TYPE, "outro").alias("notice"),
                              R.first_match(body, R.NOTICE_LEVEL).alias("level"),
                              R.post_subject(F.lit("Geral"), "text").alias("subject"))


@query("rule_document_type", f"""
WITH s AS (SELECT doc_id, {NORM.format("source || CASE doc_id % 4 WHEN 0 THEN ' edital' WHEN 1 THEN ' processo seletivo' WHEN 2 THEN ' errata' ELSE '' END")} AS sec,
 {NORM.format("text || CASE doc_id % 3 WHEN 0 THEN ' Cronograma de entrevistas' WHEN 1 THEN ' Ficha de inscrição' ELSE '' END")} AS txt FROM documents)
SELECT doc_id, coalesce({case_sql('txt', R.DOCUMENT_BY_STRONG_TEXT)}, {case_sql('sec', R.DOCUMENT_BY_SECTION)}, {case_sql('txt', R.DOCUMENT_BY_TEXT, 'outro')}) AS kind FROM s""")
def rule_document_type(t):
    # The tails stand for the words of notices, which the synthetic texts lack.
    kind = F.col("doc_id") % 4
    section = F.concat("source", F.when(kind == 0, " edital").when(kind == 1, " processo seletivo").when(kind == 2, " errata").otherwise(""))
    link = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Cronograma de entrevistas").when(
        F.col("doc_id") % 3 == 1, " Ficha de inscrição").otherwise(""))
    return t.documents.select("doc_id", R.document_type(section, link).alias("kind"))


@query("rule_route", f"""
SELECT conv_id, turn, {case_sql(NORM.format("text || CASE turn % 4 WHEN 0 THEN ' quem pesquisa' WHEN 1 THEN ' projeto' WHEN 2 THEN ' Endereço' ELSE '' END"), R.ROUTES)} AS collection FROM conversations""")
def rule_route(t):
    # The tail stands for the question words the synthetic turns lack.
    tail = (F.when(F.col("turn") % 4 == 0, " quem pesquisa").when(F.col("turn") % 4 == 1, " projeto")
            .when(F.col("turn") % 4 == 2, " Endereço").otherwise(""))
    return t.conversations.select("conv_id", "turn", R.route(F.concat("text", tail)).alias("collection"))


@query("router_reply_parse", """
WITH s AS (SELECT doc_id, (length(text) % 11) / 10 AS c,
 CASE WHEN contains(text, 'tion') THEN 'ufpel_cursos' WHEN contains(text, 'der') THEN 'ufpel_projetos' ELSE 'outra' END AS col FROM documents)
SELECT doc_id, CASE WHEN c >= 0.6 AND col <> 'outra' THEN col END AS collection FROM s""")
def router_reply_parse(t):
    name = F.when(F.contains("text", F.lit("tion")), "ufpel_cursos").when(F.contains("text", F.lit("der")), "ufpel_projetos").otherwise("outra")
    told = F.to_json(F.struct(name.alias("collection"), ((F.length("text") % 11) / 10).alias("confidence"),
                              F.translate("text", "{}", "()").alias("motivo")))
    return t.documents.select("doc_id", R.routed_reply(F.concat(F.lit("Claro!\n"), told, F.lit(" fim }"))).alias("collection"))


#: A word of the text long enough to be none of the question words.
_SUBJECT = "[a-z]{6,}"


@query("question_intent", f"""
WITH s AS (SELECT conv_id, turn, turn % 5 AS i, coalesce(nullif(regexp_extract(lower(text), '{_SUBJECT}'), ''), 'calculo') AS w FROM conversations)
SELECT conv_id, turn, CASE i WHEN 0 THEN 'CREDITOS_FILTER' WHEN 1 THEN 'PROFS_CURSO' END AS kind, CASE WHEN i < 2 THEN w END AS course,
 CASE WHEN i = 0 THEN '3º Semestre' END AS semester, CASE WHEN i = 0 THEN 4 END AS credits, i = 2 AS area, i = 3 AS more,
 CASE i WHEN 0 THEN 'curso' WHEN 1 THEN 'servidor' END AS hint,
 CASE i WHEN 0 THEN w || ' com 4 créditos no 3º semestre' WHEN 1 THEN 'do curso de ' || w WHEN 2 THEN 'quem pesquisa ' || w WHEN 3 THEN 'fale mais disciplinas ' || w ELSE w END AS entity
FROM s""")
def question_intent(t):
    word = F.coalesce(F.nullif(F.regexp_extract(F.lower("text"), _SUBJECT, 0), F.lit("")), F.lit("calculo"))
    kind = F.col("turn") % 5
    asked = (F.when(kind == 0, F.concat(F.lit("quais disciplinas do curso de "), word, F.lit(" com 4 créditos no 3º semestre?")))
             .when(kind == 1, F.concat(F.lit("corpo docente do curso de "), word)).when(kind == 2, F.concat(F.lit("quem pesquisa "), word))
             .when(kind == 3, F.concat(F.lit("fale mais disciplinas "), word)).otherwise(F.concat(F.lit("qual a ementa de "), word, F.lit("?"))))
    s = t.conversations.select("conv_id", "turn", asked.alias("asked")).withColumn("i", R.intent("asked"))
    return s.select("conv_id", "turn", F.col("i.kind").alias("kind"), F.col("i.course").alias("course"),
                    F.col("i.semester").alias("semester"), F.col("i.credits").alias("credits"),
                    R.is_area_question("asked").alias("area"), R.is_continuation("asked").alias("more"),
                    R.type_hint("asked").alias("hint"), R.entity_candidate("asked").alias("entity"))


@query("partition_pages", f"""
WITH s AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '') AS path FROM pages),
k AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ppgc/' || path WHEN 1 THEN 'selecao-' || path WHEN 2 THEN path ELSE 'research/' || path END AS path, page_id FROM s)
SELECT page_id, (path LIKE 'ppgc/%' OR regexp_matches(split_part(path, '/', -1), {lit(R.PROGRAMME_SLUG)}) OR page_id % 10 = 6) AS programme,
 CASE split_part(path, '/', 1) WHEN 'ppgc' THEN 'pos-graduacao' WHEN 'research' THEN 'pesquisa' END AS section FROM k""")
def partition_pages(t):
    raw = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*/", ""), r"[?#].*$", "")
    head = F.element_at(F.array(F.lit("ppgc/"), F.lit("selecao-"), F.lit(""), F.lit("research/")), (F.col("page_id") % 4 + 1).cast("int"))
    path = F.concat(head, raw)
    title = F.when(F.col("page_id") % 10 == 6, "Pós-Graduação em Computação").otherwise("Notícias")
    slug = F.element_at(F.split(path, "/"), -1)
    return t.pages.select("page_id", R.page_in_programme(path, slug, title).alias("programme"), R.section_of(path).alias("section"))


@query("active_status", """
SELECT o_orderkey, (o_orderstatus <> 'F' AND (o_orderpriority = '5-LOW' OR o_orderdate::DATE + 3 >= DATE '1999-01-01')) AS active,
 (o_orderpriority = '5-LOW' OR o_orderdate::DATE + 3 >= DATE '1999-01-01') AS in_force FROM orders""")
def active_status(t):
    status = F.when(F.col("o_orderstatus") == "F", "Excluído em 2019").when(F.col("o_orderstatus") == "O", "Ativo Permanente")
    exit_date = F.when(F.col("o_orderpriority") != "5-LOW", F.date_add(F.to_date("o_orderdate"), 3))
    today = F.lit("1999-01-01").cast("date")
    return t.orders.select("o_orderkey", R.is_active(status, exit_date, today).alias("active"), R.in_force(exit_date, today).alias("in_force"))


# --- guards ------------------------------------------------------------------------------------

PII_SQL = case_sql("text", R.PERSONAL_DATA)
INJ_SQL = any_sql("lower(text)", R.INJECTION)
SCOPE_SQL = (
    "CASE WHEN " + any_sql("n", R.OFF_TOPIC) + "".join(
        f" OR regexp_matches(regexp_replace(n, {lit(a)}, '~', 'g'), {lit(b)})" for b, a in R.OFF_TOPIC_UNLESS)
    + " THEN 'off_topic' WHEN ws <= 3 THEN NULL WHEN len(list_filter(["
    + ", ".join(lit(x) for x in R.ON_TOPIC) + "], lambda x: contains(n, x))) = 0 THEN 'no_topic_term' END")
LEN_SQL = "CASE WHEN length({0}) < 2 THEN 'too_short' WHEN length({0}) > 1000 THEN 'too_long' END".format(WS_STRIP.format("text"))


@query("guard_length", f"SELECT doc_id, {LEN_SQL} AS reason FROM documents")
def guard_length(t):
    return t.documents.select("doc_id", R.guard_length("text").alias("reason"))


@query("guard_injection", f"SELECT doc_id, CASE WHEN {INJ_SQL} THEN 'injection' END AS reason FROM documents")
def guard_injection(t):
    return t.documents.select("doc_id", R.guard_injection("text").alias("reason"))


@query("guard_pii", f"SELECT doc_id, {PII_SQL} AS kind FROM documents")
def guard_pii(t):
    return t.documents.select("doc_id", R.personal_data_type("text").alias("kind"))


@query("guard_chain", f"""
WITH s AS (SELECT doc_id, text, {NORM.format('text')} AS n, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS ws FROM documents),
g AS (SELECT doc_id, {LEN_SQL} AS l, CASE WHEN {INJ_SQL} THEN 'injection' END AS i, {PII_SQL} AS p, {SCOPE_SQL} AS sc FROM s)
SELECT doc_id, l IS NULL AND i IS NULL AND p IS NULL AND sc IS NULL AS passed,
 CASE WHEN l IS NOT NULL THEN 'length' WHEN i IS NOT NULL THEN 'injection' WHEN p IS NOT NULL THEN 'pii' WHEN sc IS NOT NULL THEN 'scope' ELSE 'all' END AS check_name,
 coalesce(l, i, p, sc, 'ok') AS reason,
 CASE WHEN l IS NOT NULL THEN 'low' WHEN i IS NOT NULL THEN 'high' WHEN p IS NOT NULL THEN 'medium' WHEN sc = 'off_topic' THEN 'medium' ELSE 'low' END AS severity FROM g""")
def guard_chain(t):
    return t.documents.select("doc_id", R.guard_input("text").alias("g")).select(
        "doc_id", "g.passed", F.col("g.check").alias("check_name"), "g.reason", "g.severity")


@query("guard_scope_questions", f"""
WITH s AS (SELECT conv_id, turn, {NORM.format("text || CASE WHEN turn % 2 = 0 THEN ' direito autoral do curso' ELSE ' direito' END")} AS n,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) + CASE WHEN turn % 2 = 0 THEN 4 ELSE 1 END AS ws FROM conversations)
SELECT conv_id, turn, {SCOPE_SQL} AS reason FROM s""")
def guard_scope_questions(t):
    tail = F.when(F.col("turn") % 2 == 0, " direito autoral do curso").otherwise(" direito")
    return t.conversations.select("conv_id", "turn", R.guard_scope(F.concat("text", tail)).alias("reason"))


@query("guard_output", f"""
SELECT doc_id, CASE WHEN {WS_STRIP.format('text')} = '' THEN 'empty' WHEN length(text) > 8000 THEN 'length' END AS reason,
 {any_sql(NORM.format('text'), R.REFUSAL)} AS refusal FROM documents""")
def guard_output(t):
    return t.documents.select("doc_id", R.guard_output("text").alias("reason"), R.is_refusal("text").alias("refusal"))


@query("guard_simple", f"""
SELECT doc_id, CASE WHEN length({WS_STRIP.format('text')}) < 5 THEN 'short' WHEN {any_sql('lower(text)', R.SIMPLE_INJECTION)} THEN 'injection'
 ELSE {case_sql('text', R.SIMPLE_PERSONAL_DATA)} END AS reason FROM documents""")
def guard_simple(t):
    return t.documents.select("doc_id", R.guard_simple("text").alias("reason"))


QUOTED = r"'[^']*'"


@query("guard_sql_text", f"""
WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'select ' || text
 WHEN 2 THEN 'with x as (select ''' || replace(text, '''', '''''') || ''') select * from x;'
 ELSE 'select ''' || replace(text, '''', '''''') || ''' as a delete' END AS st FROM documents),
c AS (SELECT doc_id, trim(regexp_replace({WS_STRIP.format('st')}, ';\\s*$', '')) AS st FROM s),
b AS (SELECT doc_id, st, regexp_replace(st, {lit(QUOTED)}, '''''', 'g') AS bare FROM c)
SELECT doc_id, CASE WHEN contains(bare, ';') THEN 'many_statements' WHEN NOT regexp_matches(st, '(?i)^(select|with)\\b') THEN 'not_a_select'
 WHEN regexp_matches(strip_accents(bare), {lit(R.SQL_FORBIDDEN)}) THEN 'forbidden_keyword' END AS reason FROM b""")
def guard_sql_text(t):
    quoted = F.concat(F.lit("'"), F.replace("text", F.lit("'"), F.lit("''")), F.lit("'"))
    kind = F.col("doc_id") % 4
    statement = (F.when(kind == 0, F.col("text")).when(kind == 1, F.concat(F.lit("select "), "text"))
                 .when(kind == 2, F.concat(F.lit("with x as (select "), quoted, F.lit(") select * from x;")))
                 .otherwise(F.concat(F.lit("select "), quoted, F.lit(" as a delete"))))
    return t.documents.select("doc_id", R.guard_sql(statement).alias("reason"))


@query("cache_key", f"""
WITH s AS (SELECT doc_id, {WS_STRIP.format("regexp_replace(regexp_replace(" + WS_STRIP.format("lower(text)") + ", '\\s+', ' ', 'g'), '[?!.,;]$', '')")} AS q FROM documents)
SELECT doc_id, q AS question, sha256(q) AS key FROM s""")
def cache_key(t):
    from ..operators import respcache
    return respcache.keyed(t.documents, "text").select("doc_id", "question", "key")


# --- chunking -------------------------------------------------------------------------------------

WORDS_SQL = "w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents)"
WINDOW_SQL = f"""{WORDS_SQL},
n AS (SELECT doc_id, ws, len(ws) AS n, (ceil(greatest(len(ws) - 150, 0) / 120.0) * 120)::BIGINT AS last FROM w WHERE len(ws) > 0),
p AS (SELECT doc_id, ws, unnest(list_concat(range(0, last + 1, 120), range(greatest(n - 30, last + 1), n))) AS s FROM n),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_ix, array_to_string(ws[s + 1 : s + 150], ' ') AS chunk FROM p)"""


@query("chunk_word_window", f"WITH {WINDOW_SQL} SELECT doc_id, chunk_ix, chunk FROM c")
def chunk_word_window(t):
    return t.documents.select("doc_id", F.posexplode(C.word_windows("text", 150, 30)).alias("chunk_ix", "chunk"))


@query("chunk_word_window_clean", f"""WITH {WORDS_SQL},
p AS (SELECT doc_id, ws, unnest(range(0, (ceil(greatest(len(ws) - 100, 0) / 80.0) * 80)::BIGINT + 1, 80)) AS s FROM w WHERE len(ws) > 0)
SELECT doc_id, s // 80 AS chunk_ix, array_to_string(ws[s + 1 : s + 100], ' ') AS chunk FROM p""")
def chunk_word_window_clean(t):
    return t.documents.select("doc_id", F.posexplode(C.word_windows("text", 100, 20, "clean")).alias("chunk_ix", "chunk"))


CHAR_WINDOW_SQL = f"""WITH RECURSIVE src AS (SELECT doc_id, {WS_STRIP.format('text')} AS t FROM documents),
walk AS (
  SELECT doc_id, t, length(t) AS n, 0::BIGINT AS beg, 0::BIGINT AS pos,
    CASE WHEN length(t) <= 2000 THEN length(t) ELSE (SELECT CASE WHEN b > 1000 THEN b + 1 ELSE 2000 END FROM (
      SELECT greatest(CASE WHEN instr(reverse(left(t, 2000)), chr(10)) = 0 THEN -1 ELSE 2000 - instr(reverse(left(t, 2000)), chr(10)) END,
                      CASE WHEN instr(reverse(left(t, 2000)), ' ') = 0 THEN -1 ELSE 2000 - instr(reverse(left(t, 2000)), ' ') END) AS b)) END AS stop
  FROM src WHERE length(t) > 0
  UNION ALL
  SELECT doc_id, t, n, s, pos + 1,
    CASE WHEN s + 2000 >= n THEN n ELSE s + CASE WHEN b > 1000 THEN b + 1 ELSE 2000 END END
  FROM (SELECT *, greatest(CASE WHEN instr(reverse(w), chr(10)) = 0 THEN -1 ELSE length(w) - instr(reverse(w), chr(10)) END,
                           CASE WHEN instr(reverse(w), ' ') = 0 THEN -1 ELSE length(w) - instr(reverse(w), ' ') END) AS b
        FROM (SELECT *, substr(t, s + 1, 2000) AS w FROM (SELECT *, greatest(stop - 200, beg + 1) AS s FROM walk WHERE stop < n)))),
pieces AS (SELECT doc_id, pos, {WS_STRIP.format('substr(t, beg + 1, stop - beg)')} AS piece, t, count(*) OVER (PARTITION BY doc_id) AS n FROM walk)"""


@query("chunk_char_window", f"{CHAR_WINDOW_SQL} SELECT doc_id, pos AS chunk_ix, piece AS chunk FROM pieces")
def chunk_char_window(t):
    return t.documents.select("doc_id", F.posexplode(C.char_windows("text")).alias("chunk_ix", "chunk"))


@query("chunk_recursive")
def chunk_recursive(t):
    return C.chunk(t.documents, "doc_id", "text", "recursivo")


@query("chunk_sections")
def chunk_sections(t):
    return C.section_chunks(t.documents, "doc_id", "text")


@query("chunk_sweep")
def chunk_sweep(t):
    return C.sweep(t.documents, "text")


@query("chunk_overlap_prefix", f"""WITH {WINDOW_SQL},
l AS (SELECT *, lag(chunk) OVER (PARTITION BY doc_id ORDER BY chunk_ix) AS prev FROM c),
k AS (SELECT *, right(prev, 20) AS tail FROM l),
m AS (SELECT *, trim(CASE WHEN instr(tail, ' ') > 0 AND instr(tail, ' ') < length(tail) THEN substr(tail, instr(tail, ' ') + 1) ELSE tail END) AS a FROM k)
SELECT doc_id, chunk_ix, CASE WHEN prev IS NULL OR a = '' THEN chunk ELSE a || chr(10) || chunk END AS chunk FROM m""")
def chunk_overlap_prefix(t):
    return t.documents.select("doc_id", F.posexplode(C.overlap_prefix(C.word_windows("text", 150, 30))).alias("chunk_ix", "chunk"))


@query("facet_emit", f"""{CHAR_WINDOW_SQL}
SELECT doc_id AS key, split_part(source, '#', 1) AS family, count(*) AS pieces, sum(length(piece)) AS chars
FROM pieces JOIN documents USING (doc_id) WHERE length(t) >= {C.MIN_FACET} GROUP BY 1, 2""")
def facet_emit(t):
    title = F.concat(F.lit("Documento "), F.col("doc_id").cast("string"))
    rows = C.facets(t.documents, "doc_id", scope=F.col("source"), title=title, text=F.col("text"))
    # Without its header, which ends with the first line.
    body = F.length("text") - F.locate("\n", "text")
    return rows.groupBy("key", C.scope_family("scope").alias("family")).agg(
        F.count("*").alias("pieces"), F.sum(body).alias("chars"))


@query("facet_pieces", f"""{CHAR_WINDOW_SQL}
SELECT doc_id AS key, source || CASE WHEN pos = 0 THEN '' ELSE '#' || (pos + 1) END AS scope, 'Documento ' || doc_id AS title,
 NULL::VARCHAR AS url, 'Documento ' || doc_id || CASE WHEN n > 1 THEN ' (parte ' || (pos + 1) || '/' || n || ')' ELSE '' END || chr(10) || piece AS text,
 pos + 1 AS chunk, n AS chunks FROM pieces JOIN documents USING (doc_id) WHERE length(t) >= {C.MIN_FACET}""")
def facet_pieces(t):
    return C.facets(t.documents, "doc_id", scope=F.col("source"),
                    title=F.concat(F.lit("Documento "), F.col("doc_id").cast("string")), text=F.col("text"))


@query("facet_pieces_portal", f"""{CHAR_WINDOW_SQL}
SELECT doc_id AS key, source || CASE WHEN n = 1 THEN '' ELSE '#' || pos END AS scope, lang AS title, NULL::VARCHAR AS url,
 CASE WHEN pos = 0 THEN piece ELSE left(split_part(t, chr(10) || chr(10), 1), 400) || chr(10) || '(continuação ' || (pos + 1) || ')' || chr(10) || piece END AS text,
 pos AS chunk, n AS chunks FROM pieces JOIN documents USING (doc_id) WHERE length(t) >= {C.MIN_PORTAL_FACET}""")
def facet_pieces_portal(t):
    return C.portal_facets(t.documents, "doc_id", scope=F.col("source"), title=F.col("lang"), text=F.col("text"))


# --- HTML ---------------------------------------------------------------------------------------------


def _drop_sql(col: str, names) -> str:
    out = f"regexp_replace({col}, '<!--.*?-->', '', 'gs')"
    for n in names:
        out = f"regexp_replace({out}, '<{n}\\b[^>]*>.*?</{n}\\s*>', '', 'gsi')"
    return out


ENTITY_SQL = ("replace(replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), "
              "'&lt;', '<'), '&gt;', '>'), '&amp;', '&')")
TIDY_SQL = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[ \\t]+', ' ', 'g'), "
            "'[ \\t]*\\n[ \\t]*', chr(10), 'g'), ' +([,.;:!?%)\\]])', '\\1', 'g'), '([(\\[]) +', '\\1', 'g'), '^\\s+|\\s+$', '', 'g')")


def _text_sql(col: str, drop) -> str:
    t = _drop_sql(col, ("head",) + tuple(drop))
    t = f"regexp_replace({t}, '<br\\s*/?>', chr(10), 'gi')"
    t = f"regexp_replace({t}, '<li\\b[^>]*>', chr(10) || '- ', 'gi')"
    t = f"regexp_replace({t}, '</li\\s*>', chr(10), 'gi')"
    t = f"regexp_replace({t}, '</?({'|'.join(H.BLOCKS)})\\b[^>]*>', chr(10), 'gi')"
    t = TIDY_SQL.format(ENTITY_SQL.format(f"regexp_replace({t}, '<[^>]*>', ' ', 'gs')"))
    return (f"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x)), "
            "lambda x: x <> '' AND x <> '-'), chr(10))")


@query("html_text", f"SELECT page_id, {_text_sql('html', H.NOISE)} AS text FROM pages")
def html_text(t):
    return t.pages.select("page_id", H.to_text("html", H.NOISE).alias("text"))


LINK_SQL = r"""
l AS (SELECT page_id, url AS base, regexp_extract_all(html, '<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>.*?</a\s*>', 1, 'si') AS hs,
  regexp_extract_all(html, '<a\b[^>]*?\bhref\s*=\s*["''][^"'']*["''][^>]*>(.*?)</a\s*>', 1, 'si') AS bs FROM pages),
u AS (SELECT page_id, base, unnest(hs) AS h, unnest(bs) AS b, generate_subscripts(hs, 1) AS i FROM l),
f AS (SELECT page_id, i, CASE WHEN regexp_matches(h, '^[a-z]+:') THEN h ELSE regexp_extract(base, '^[a-z]+://[^/?#]*') || h END AS url,
  """ + TIDY_SQL.format(ENTITY_SQL.format("regexp_replace(b, '<[^>]*>', ' ', 'g')")) + r""" AS text FROM u WHERE h <> '' AND h NOT LIKE '#%'),
d AS (SELECT page_id, url, nullif(text, '') AS text, min(i) AS i FROM f GROUP BY 1, 2, 3),
links AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS ordem, url, text FROM d)"""


def page_links(t):
    return t.pages.select("page_id", F.posexplode(H.links("html", "url")).alias("ordem", "l")).select(
        "page_id", "ordem", F.col("l.url").alias("url"), F.col("l.text").alias("text"))


@query("html_links", f"WITH {LINK_SQL} SELECT page_id, ordem, url, text FROM links")
def html_links(t):
    return page_links(t)


@query("link_classes", f"""WITH {LINK_SQL},
p AS (SELECT page_id, ordem, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '') AS path FROM links),
e AS (SELECT *, nullif(lower(regexp_extract(path, '\\.([A-Za-z0-9]{{1,5}})$', 1)), '') AS ext, nullif(split_part(path, '/', -1), '') AS file FROM p)
SELECT page_id, ordem, host, ext, file, CASE WHEN ext IN ('pdf','doc','docx','odt','rtf') THEN 'documento' WHEN ext IN ('xls','xlsx','ods','csv') THEN 'planilha'
 WHEN ext IN ('jpg','jpeg','png','gif','webp','svg') THEN 'imagem' WHEN host LIKE '%example.com' THEN 'interno' ELSE 'externo' END AS kind FROM e""")
def link_classes(t):
    u = F.col("url")
    return page_links(t).select("page_id", "ordem", H.host(u).alias("host"), H.extension(u).alias("ext"),
                                H.file_name(u).alias("file"), H.link_class(u, "example.com").alias("kind"))


@query("html_sections", f"""
WITH b AS (SELECT page_id, {_drop_sql('html', ('head',) + tuple(H.IGNORED))} AS h FROM pages),
p AS (SELECT page_id, regexp_extract(h, '^(.*?)<h1\\b', 1, 'si') AS pre, regexp_extract(h, '<h1\\b[^>]*>(.*?)</h1\\s*>', 1, 'si') AS head,
 regexp_extract(h, '</h1\\s*>(.*)$', 1, 'si') AS post FROM b)
SELECT page_id, 0 AS ordem, NULL::VARCHAR AS title, 0 AS level, NULL::VARCHAR AS anchor, {_text_sql('pre', H.IGNORED)} AS text FROM p
UNION ALL SELECT page_id, 1, {TIDY_SQL.format(ENTITY_SQL.format("regexp_replace(head, '<[^>]*>', ' ', 'g')"))}, 1, NULL, {_text_sql('post', H.IGNORED)} FROM p""")
def html_sections(t):
    return t.pages.select("page_id", F.posexplode(H.sections("html")).alias("ordem", "s")).select(
        "page_id", "ordem", F.col("s.title").alias("title"), F.col("s.level").alias("level"),
        F.col("s.anchor").alias("anchor"), F.col("s.text").alias("text"))


@query("page_reader", f"""
SELECT page_id, CASE WHEN length(x) > 4500 THEN left(x, 4500) || ' [...]' ELSE x END AS text FROM (
 SELECT page_id, {_text_sql('html', ('script', 'style', 'nav', 'footer', 'header', 'noscript'))} AS x FROM pages
 WHERE regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '(^|\\.)example\\.(com|org)$'))""")
def page_reader(t):
    from ..plans import tools
    return tools.read_pages(t.pages, ("example.com", "example.org")).select("page_id", "text")


@query("page_menu", r"""
WITH m AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS us,
 regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS ts FROM pages),
u AS (SELECT page_id, unnest(us) AS url, unnest(ts) AS t, generate_subscripts(us, 1) AS ordem FROM m)
SELECT page_id, ordem, """ + TIDY_SQL.format(ENTITY_SQL.format("t")) + r""" AS title, url, 0 AS level FROM u""")
def page_menu(t):
    from ..operators import extract
    from ..sources import elements
    return extract.menu(elements.elements(t.pages, keep=True)).select("page_id", "ordem", "title", "url", "level")


@query("page_blocks", f"""
SELECT page_id, count(*) AS paragraphs FROM (SELECT page_id, unnest(regexp_extract_all({_drop_sql('html', ('script', 'style', 'head'))}, '<p>')) AS p FROM pages) GROUP BY 1""")
def page_blocks(t):
    from ..sources import elements
    els = elements.elements(t.pages)
    return els.filter(F.col("tag") == "p").groupBy("page_id").agg(F.count("*").alias("paragraphs"))


@query("chunk_recursive_cover", """
SELECT doc_id, sha256(regexp_replace(text, '\\s+', '', 'g')) AS content, true AS within FROM documents""")
def chunk_recursive_cover(t):
    """Without overlap the pieces hold every character but blanks, in order, none longer than the size."""
    pieces = t.documents.select("doc_id", C.recursive("text", C.SIZE, 0).alias("p"))
    return pieces.select("doc_id", F.sha2(F.regexp_replace(F.array_join("p", ""), r"[\s\x0B]+", ""), 256).alias("content"),
                         F.forall("p", lambda x: F.length(x) <= C.SIZE).alias("within"))


#: Text under headers, as the section splitter expects it, from the columns of a table.
SECTIONED = ("Nome do Projeto: ", "\nResumo: ", "\nEquipe: ", "\nUnidade: ")


@query("chunk_sections_cover", """
SELECT doc_id, true AS structured, 'Nome do Projeto|Resumo|Equipe|Unidade' AS headers,
 sha256(regexp_replace('NomedoProjeto:' || source || 'Resumo:' || text || 'Equipe:' || lang || 'Unidade:' || n_chars, '\\s+', '', 'g')) AS content
FROM documents""")
def chunk_sections_cover(t):
    """The chunks of sectioned text name every header once and hold its words in order, overlaps aside."""
    parts = [F.col("source"), F.col("text"), F.col("lang"), F.col("n_chars").cast("string")]
    docs = t.documents.select("doc_id", F.concat(*[x for h, c in zip(SECTIONED, parts) for x in (F.lit(h), c)]).alias("text"))
    rows = C.section_chunks(docs, "doc_id", "text", section_overlap=0)
    whole = rows.groupBy("doc_id").agg(
        F.bool_and("structured").alias("structured"), F.array_sort(F.collect_list(F.struct("chunk_ix", "chunk", "section_headers"))).alias("c"))
    return whole.select(
        "doc_id", "structured", F.array_join(F.flatten(F.transform("c", lambda x: x["section_headers"])), "|").alias("headers"),
        F.sha2(F.regexp_replace(F.array_join(F.transform("c", lambda x: x["chunk"]), ""), r"[\s\x0B]+", ""), 256).alias("content"))
