"""Whole-page records, histories, provider chains and the streaming ingest over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import session
from ..operators import chunk as C
from ..operators import history, records
from ..sources import elements
from ..streaming import ingest
from .parsed import _pages
from .registry import query
from .stored import CHAR_WINDOW_SQL

LABEL = "<span class='ficha-label'>{}</span><span class='ficha-campo'>"


def _card(name: str, value) -> list:
    return ["<div>", LABEL.format(name), value, "</span></div>"]


@query("parse_legacy_subject", """
SELECT p_partkey AS page_id, p_name AS titulo, p_partkey::VARCHAR AS codigo, p_size::VARCHAR AS creditos, p_type AS ementa,
 p_brand AS extra, 2::BIGINT AS n_turmas, 'T' || p_size AS turma, p_size::VARCHAR AS vagas, p_brand AS curso, 'ANA ' || p_brand AS professor,
 'Disciplina: ' || p_name || ' (código ' || p_partkey || ') — UFPel' || chr(10) || 'Ementa: ' || p_type || chr(10) || 'Cursos: ' || p_brand AS embedding_text
FROM part""")
def parse_legacy_subject(t):
    """Subject pages built from parts; the record is read by path."""
    row = ["<tr><td>T", F.col("p_size"), "</td><td>2026/1</td><td>", F.col("p_size"), "</td><td>3</td><td><a href='/cursos/cod/1'>", F.col("p_brand"),
           "</a></td><td>Professor responsável pela turma:<br>ANA ", F.col("p_brand"), "</td></tr>"]
    p = _pages(t.part, "p_partkey", "<h1>Página</h1><div class='ficha-dados'>", *_card("Código:", F.col("p_partkey")), *_card("Nome da Atividade:", F.col("p_name")),
               *_card("CRÉDITOS:", F.col("p_size")), "</div><div id='informacoes'><h3 class='cor-fundo'>Ementa</h3><div><p>", F.col("p_type"), "</p></div><h3 class='cor-fundo'>Avaliação</h3><div><p>",
               F.col("p_brand"), "</p></div></div><table><tr><td>outra</td><td>b</td><td>c</td><td>d</td></tr></table><h3>Turmas Ofertadas</h3><table><tr><th>Turma</th><th>Período</th>"
               "<th>Vagas</th><th>Mat.</th><th>Curso</th><th>Professores</th></tr>", *row, "<tr><td>curta</td></tr>", *row, "</table>")
    made = records.subjects(elements.elements(p, keep=True), t.part.select(F.col("p_partkey").alias("page_id"), F.col("p_brand").alias("course")))
    at = lambda path, name, kind="string": F.variant_get("record", path, kind).alias(name)
    return made.select(
        "page_id", "titulo", at("$.codigo", "codigo"), at("$.creditos", "creditos"), at("$.ementa", "ementa"), at('$.outras_secoes["Avaliação"]', "extra"),
        F.size(F.variant_get("record", "$.turmas_ofertadas", "array<variant>")).cast("long").alias("n_turmas"), at("$.turmas_ofertadas[1].turma", "turma"),
        at("$.turmas_ofertadas[0].vagas", "vagas"), at("$.turmas_ofertadas[0].curso", "curso"), at("$.turmas_ofertadas[0].professores[0]", "professor"), "embedding_text")


@query("parse_legacy_course", """
SELECT c_custkey AS page_id, c_name || ' (' || c_mktsegment || ')' AS titulo, c_mktsegment AS nivel, 'Curso ' || c_nationkey AS apresentacao,
 '1º Semestre' AS semestre, 'Aula ' || c_custkey AS disciplina, 'https://x/disciplinas/cod/' || c_nationkey AS url, c_name AS pessoa, c_mktsegment AS unidade,
 'Aula ' || c_custkey AS turma_disciplina, c_name AS turma_professor, c_nationkey::VARCHAR AS vagas,
 'Curso: ' || c_name || ' — UFPel' || chr(10) || 'Nível: ' || c_mktsegment || ' | Modalidade:  | Turno: Noite' || chr(10) || 'Unidade responsável: '
 || chr(10) || 'Coordenador: ' || chr(10) || chr(10) || 'Sobre o curso:' || chr(10) || 'Curso ' || c_nationkey AS embedding_text FROM customer""")
def parse_legacy_course(t):
    """Course pages built from customers: curriculum, staff and classes in one record."""
    link = ["<a href='https://x/disciplinas/cod/", F.col("c_nationkey"), "'>Aula ", F.col("c_custkey"), "</a>"]
    p = _pages(t.customer, "c_custkey", "<h1>", F.col("c_name"), "</h1><div class='ficha-dados'>", *_card("Nível / Grau:", F.col("c_mktsegment")), *_card("Turno:", "Noite"),
               "</div><h3 class='cor-fundo'>Apresentação</h3><div><p>Curso ", F.col("c_nationkey"), "</p></div><div id='curriculo'><h3 class='cor-fundo'>1º Semestre</h3>"
               "<table><tr><th>Código</th><th>Disciplina</th></tr><tr><td>", F.col("c_custkey"), "</td><td>", *link, "</td></tr></table></div><div id='professores'><table><tr>"
               "<td class='h-card'><a class='u-url' href='/servidores/id/1'><span class='p-name'>", F.col("c_name"), "</span></a><span class='p-org'>", F.col("c_mktsegment"),
               "</span></td></tr></table></div><div id='turmas'><table class='tabela-dados'><tr><th>D</th><th>T</th><th>V</th><th>M</th></tr><tr><td>", *link,
               "<span class='tabela-detalhe-info'>Professor Regente: ", F.col("c_name"), "</span></td><td>M1</td><td>", F.col("c_nationkey"), "</td><td>9</td></tr></table></div>")
    made = records.courses(elements.elements(p, keep=True))
    at = lambda path, name: F.variant_get("record", path, "string").alias(name)
    return made.select("page_id", "titulo", at("$.nivel", "nivel"), at('$.informacoes["Apresentação"]', "apresentacao"), at("$.matriz_curricular[0].semestre", "semestre"),
                       at("$.matriz_curricular[0].Disciplina", "disciplina"), at("$.matriz_curricular[0].url", "url"), at("$.professores[0].nome", "pessoa"),
                       at("$.professores[0].unidade", "unidade"), at("$.turmas_ofertadas[0].disciplina", "turma_disciplina"),
                       at("$.turmas_ofertadas[0].professores[0]", "turma_professor"), at("$.turmas_ofertadas[0].vagas", "vagas"), "embedding_text")


@query("history_compaction", f"""
WITH m AS (SELECT *, sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id) AS chars,
  max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations),
s AS (SELECT *, CASE WHEN role = 'assistant' AND turn < last AND length(text) > 700 THEN length(text) - {600 + len(history.CUT_MARK)} ELSE 0 END AS saves FROM m),
c AS (SELECT *, saves > 0 AND floor((chars - (sum(saves) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - saves)) / 3.5) > 400 AS shortened FROM s)
SELECT conv_id, turn, shortened, CASE WHEN shortened THEN left(text, 600) || chr(10) || '{history.CUT_MARK.strip()}' ELSE text END AS text FROM c""")
def history_compaction(t):
    """Conversations cut to 400 tokens, answers standing for tool results."""
    return history.compacted(t.conversations, F.col("role") == "assistant", max_tokens=400).select("conv_id", "turn", "shortened", "text")


@query("provider_chain", """
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type <> 'error' OR value < 20 AS w0, value < 60 AS w1, event_id % 7 <> 0 AS w2,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, n, event_id, 0 AS "primary", CASE WHEN w0 THEN 0 WHEN w1 THEN 1 WHEN w2 THEN 2 END AS provider FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.n, e.event_id, coalesce(r.provider, r."primary"),
  CASE WHEN coalesce(r.provider, r."primary") <= 0 AND w0 THEN 0 WHEN coalesce(r.provider, r."primary") <= 1 AND w1 THEN 1 WHEN w2 THEN 2 END
 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id, provider, "primary" FROM r""")
def provider_chain(t):
    """Which of three providers serves each user's events, in blocks of one day."""
    works = [(F.col("event_type") != "error") | (F.col("value") < 20), F.col("value") < 60, F.col("event_id") % 7 != 0]
    day = F.unix_seconds(F.col("ts").cast("timestamp")) / 86400
    return history.provider_in_use(t.events.select("event_id", "user_id", "ts", "event_type", "value"), works, "user_id", ["ts", "event_id"], F.floor(day)).select(
        "event_id", "provider", "primary")


@query("stream_ingest", f"""{CHAR_WINDOW_SQL}
SELECT CASE doc_id % 3 WHEN 0 THEN 'ufpel_disciplinas' WHEN 1 THEN 'ufpel_projetos' ELSE 'ufpel_servidores' END AS collection,
 count(*) AS chunks, sum(length(piece)) AS chars FROM pieces GROUP BY 1""")
def stream_ingest(t):
    """The documents as a stream, cut into chunks and written by kind and by collection."""
    root = session.run_folder(t.spark, "stream-ingest")
    kind = F.element_at(F.array(F.lit("disciplina"), F.lit("projeto"), F.lit("servidor")), (F.col("doc_id") % 3 + 1).cast("int"))
    # A stream reads folders: the documents arrive as files of a landing folder, a few in a micro-batch.
    t.documents.select("doc_id", kind.alias("kind"), "text").write.parquet(f"{root}/landing")
    docs = t.spark.readStream.schema("doc_id long, kind string, text string").option("maxFilesPerTrigger", 16).parquet(f"{root}/landing")
    ingest.start(docs, root, lambda df: df.select("doc_id", "kind", F.posexplode(C.char_windows("text")).alias("chunk_ix", "chunk"))).awaitTermination()
    names = ("ufpel_disciplinas", "ufpel_projetos", "ufpel_servidores")
    parts = [ingest.collection(t.spark, root, n).groupBy("collection").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars")) for n in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
