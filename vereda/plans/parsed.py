"""Page parsers over markup that is built from the columns of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from ..operators import extract as X
from ..sources import elements, ical
from .registry import query

MONTHS = ("Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho", "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro")
MONTH_SQL = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"


def _pages(df: DataFrame, key: str, *parts: Column | str) -> DataFrame:
    """(page_id, html): one page per row, the parts put together. Parsing a page is heavy, so the rows are dealt out first."""
    html = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return session.deal(df, key).select(F.col(key).alias("page_id"), html.alias("html"))


def _month(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(day))


@query("parse_cards", """
SELECT c_custkey AS page_id, 'cargo' AS key, c_mktsegment AS value, NULL::VARCHAR AS href FROM customer
UNION ALL SELECT c_custkey, 'unidade', c_name, '/unidades/id/' || c_nationkey FROM customer""")
def parse_cards(t):
    label = "<span class='ficha-label'>{}</span><span class='ficha-campo'>"
    p = _pages(t.customer, "c_custkey", "<div class='ficha-dados'><div>", label.format("Cargo:"), F.col("c_mktsegment"),
               "</span></div><div>", label.format("Unidade (*):"), "<a href='/unidades/id/", F.col("c_nationkey"), "'>", F.col("c_name"),
               "</a></span></div><div class='vinculo oculta-exibe'>", label.format("Lotação:"), "velha</span></div><div>",
               label.format("Cargo:"), "Antigo</span></div></div>")
    return X.cards(elements.elements(p)).select("page_id", "key", "value", "href")


@query("parse_table_records", """
SELECT o_orderkey AS page_id, o_orderstatus AS situacao, o_orderpriority AS prioridade FROM orders""")
def parse_table_records(t):
    p = _pages(t.orders, "o_orderkey", "<table><tr><th>S</th><th>P</th></tr><tr><td>", F.col("o_orderstatus"), "</td><td>",
               F.col("o_orderpriority"), "<table><tr><td>interna</td></tr></table></td></tr></table>")
    rows = X.table_records(elements.elements(p)).filter(F.map_contains_key("record", F.lit("S")))
    return rows.select("page_id", F.col("record")["S"].alias("situacao"),
                       F.regexp_replace(F.col("record")["P"], r"(?s)\s*interna.*$", "").alias("prioridade"))


@query("parse_schedule", """
SELECT s_suppkey AS page_id, 'Manhã' AS period, 'SEG' AS day, lpad((7 + s_suppkey % 4)::VARCHAR, 2, '0') || ':00' AS "begin",
 lpad((8 + s_suppkey % 4)::VARCHAR, 2, '0') || ':40' AS "end" FROM supplier
UNION ALL SELECT s_suppkey, 'Tarde', 'SAB', '13:30', '15:10' FROM supplier""")
def parse_schedule(t):
    hour = F.col("s_suppkey") % 4
    p = _pages(t.supplier, "s_suppkey", "<table class='grade-horarios'><tr><th>Manhã</th><th>Tarde</th></tr><tr><td><span>SEG</span> ",
               hour + 7, ":00 - ", hour + 8, ":40</td><td><span>SÁB</span> 13:30 - 15:10</td></tr></table>")
    return X.schedule(elements.elements(p)).select("page_id", "period", "day", "begin", "end")


@query("parse_calendar", """
SELECT o_orderkey AS page_id, o_orderdate::DATE AS day, o_orderpriority AS text, 'Feriados' AS kind FROM orders""")
def parse_calendar(t):
    day = F.to_date("o_orderdate")
    p = _pages(t.orders, "o_orderkey", "<div class='cobalto-calendario-mes'>", _month(day), " / ", F.year(day),
               "</div><div class='cobalto-calendario-linha'><span class='cobalto-calendario-tipo' title='Feriados'></span>"
               "<span class='cobalto-calendario-dia'>", F.date_format(day, "dd"), " - Ter</span><span class='cobalto-calendario-descricao'>",
               F.col("o_orderpriority"), "</span></div>")
    return X.calendar(elements.elements(p)).select("page_id", "day", "text", "kind")


@query("parse_faq", """
SELECT p_partkey AS page_id, 0 AS ordem, p_brand AS subject, 'Qual o tipo de ' || p_name || '?' AS question, p_type AS answer FROM part""")
def parse_faq(t):
    p = _pages(t.part, "p_partkey", "<h3>", F.col("p_brand"), ":</h3><p><strong>Pergunta:</strong> Qual o tipo de ", F.col("p_name"),
               "?</p><p>Resposta: ", F.col("p_type"), "</p><p>Pergunta: Sem resposta?</p>")
    return X.faq(p, elements.elements(p)).select("page_id", F.col("ordem").cast("int").alias("ordem"), "subject", "question", "answer")


@query("parse_groups", """
SELECT p_partkey AS page_id, 'Grupo de pesquisa ' || p_name || ' (GP' || upper(left(p_brand, 1)) || ')' AS name,
 'GP' || upper(left(p_brand, 1)) AS acronym, '/g/' || p_partkey AS url FROM part""")
def parse_groups(t):
    p = _pages(t.part, "p_partkey", "<ul><li><a href='/g/", F.col("p_partkey"), "'>Grupo de pesquisa ", F.col("p_name"), " (GP",
               F.upper(F.left("p_brand", F.lit(1))), ")</a></li><li><a href='/h'>curto</a></li></ul>")
    return X.groups(elements.elements(p)).select("page_id", "name", "acronym", "url")


@query("parse_requirements", """
SELECT p_partkey AS page_id, 'mestrado' AS level, p_name AS requirement, p_size || ' meses' AS deadline, true AS mandatory FROM part
UNION ALL SELECT p_partkey, 'mestrado', p_type, NULL, false FROM part""")
def parse_requirements(t):
    p = _pages(t.part, "p_partkey", "<p>Requisitos para alunos de mestrado</p><table><tr><td>REQUISITOS OBRIGATÓRIOS</td><td>PRAZO</td></tr><tr><td>",
               F.col("p_name"), "</td><td>", F.col("p_size"), " meses</td></tr><tr><td>Requisitos opcionais</td><td>PRAZO</td></tr><tr><td>",
               F.col("p_type"), "</td><td></td></tr></table>")
    return X.requirements(elements.elements(p)).select("page_id", "level", "requirement", "deadline", "mandatory")


@query("parse_subjects", """
SELECT p_partkey AS page_id, p_name AS name, p_size % 9 + 1 AS credits, p_size % 2 = 0 AS aluno_especial, p_brand AS responsavel, p_type AS ementa FROM part""")
def parse_subjects(t):
    p = _pages(t.part, "p_partkey", "<ul><li><strong>", F.col("p_name"), " (", F.col("p_size") % 9 + 1,
               " créditos)</strong><br>Disponível para aluno especial? ", F.when(F.col("p_size") % 2 == 0, "Sim").otherwise("Não"),
               "<br>Responsável: ", F.col("p_brand"), "<br>Ementa: ", F.col("p_type"), "</li></ul>")
    return X.subjects(elements.elements(p)).select("page_id", "name", "credits", "aluno_especial", "responsavel", "ementa")


@query("parse_defences", """
SELECT o_orderkey AS page_id, 'tese' AS kind, 'Pessoa ' || o_orderstatus AS student, o_orderdate::DATE AS day, '14:00' AS hour FROM orders""")
def parse_defences(t):
    day = F.to_date("o_orderdate")
    p = _pages(t.orders, "o_orderkey", "<p>Defesas de tese</p><p>Pessoa ", F.col("o_orderstatus"), ", ", F.dayofmonth(day), " de ", _month(day), " de ",
               F.year(day), ", 14h00</p><p>Bia, 31 de Abril de 2026</p>")
    return X.defences(elements.elements(p)).select("page_id", "kind", "student", "day", "hour")


@query("parse_bibliography", """
SELECT p_partkey AS page_id, 'basica' AS kind, p_name AS reference, 1 AS ordem FROM part
UNION ALL SELECT p_partkey, 'complementar', p_type, 2 FROM part UNION ALL SELECT p_partkey, 'complementar', p_brand, 3 FROM part""")
def parse_bibliography(t):
    p = _pages(t.part, "p_partkey", "<p><strong>Bibliografia Básica:</strong></p><ul><li>", F.col("p_name"),
               "</li></ul><p><strong>Complementar</strong></p><ul><li>", F.col("p_type"), "</li><li>", F.col("p_brand"), "</li></ul>")
    return X.bibliography(elements.elements(p)).select("page_id", "kind", "reference", F.col("ordem").cast("int").alias("ordem"))


@query("parse_seats", """
SELECT p_partkey AS page_id, 'SISU' AS process, 2026 AS year, p_partkey % 2 + 1 AS semester, 'AC' AS quota, p_size AS seats FROM part
UNION ALL SELECT p_partkey, 'SISU', 2026, p_partkey % 2 + 1, 'TOTAL', p_size + 10 FROM part""")
def parse_seats(t):
    p = _pages(t.part, "p_partkey", "<table class='tabela-fixed'><tr><th></th><th></th><th>AC</th><th>Total</th></tr><tr><td>SISU 2026/",
               F.col("p_partkey") % 2 + 1, "</td><td>", F.col("p_size"), "</td><td>", F.col("p_size") + 10, "</td></tr></table>")
    return X.seats(elements.elements(p)).select("page_id", "process", "year", "semester", "quota", "seats")


@query("parse_indicators", """
SELECT p_partkey AS page_id, 'Enade' AS indicator, 2000 + p_size AS year, (p_partkey % 5 + 1)::VARCHAR AS grade FROM part""")
def parse_indicators(t):
    p = _pages(t.part, "p_partkey", "<span class='curso-conceito'><span class='curso-conceito-nome'>Enade (", F.col("p_size") + 2000,
               ")</span><span class='curso-conceito-nota'>", F.col("p_partkey") % 5 + 1, "</span></span>")
    return X.indicators(elements.elements(p)).select("page_id", "indicator", "year", "grade")


@query("parse_legend", """
SELECT n_nationkey AS page_id, upper(left(n_name, 2)) AS acronym, n_name AS description FROM nation""")
def parse_legend(t):
    p = _pages(t.nation, "n_nationkey", "<p>Formas de ingresso</p><table><tr><td>", F.upper(F.left("n_name", F.lit(2))), "</td><td>",
               F.col("n_name"), "</td></tr></table>")
    return X.legend(elements.elements(p)).select("page_id", "acronym", "description")


@query("parse_degree", """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN 'Doutorado' END AS level, CASE WHEN s_suppkey % 3 < 2 THEN 'FURG' END AS institution,
 CASE WHEN s_suppkey % 3 < 2 THEN 1990 + s_suppkey % 30 END AS year FROM supplier""")
def parse_degree(t):
    line = F.when(F.col("s_suppkey") % 3 < 2, F.concat(
        F.lit("Doutorado em "), F.translate("s_name", "#0123456789", ""), F.lit(" (FURG, "), (F.col("s_suppkey") % 30 + 1990).cast("string"), F.lit(")")))
    return t.supplier.withColumn("d", X.degree(F.coalesce(line, F.col("s_name")))).select(
        "s_suppkey", "d.level", "d.institution", "d.year")


@query("parse_ical", f"""
SELECT o_orderkey || '@x' AS uid, 'Pedido ' || o_orderpriority AS titulo, o_orderdate::DATE AS data_inicio, true AS dia_inteiro, 'confirmed' AS situacao,
 day(o_orderdate::DATE) || ' de ' || lower({MONTH_SQL}[month(o_orderdate::DATE)]) || ' de ' || year(o_orderdate::DATE) AS data_por_extenso FROM orders""")
def parse_ical(t):
    day = F.to_date("o_orderdate")
    text = F.concat(
        F.lit("BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:"), F.col("o_orderkey").cast("string"), F.lit("@x\nSUMMARY:Pedido \n "), "o_orderpriority",
        F.lit("\nDTSTART;VALUE=DATE:"), F.date_format(day, "yyyyMMdd"), F.lit("\nDTEND;VALUE=DATE:"), F.date_format(F.date_add(day, 1), "yyyyMMdd"),
        F.lit("\nSTATUS:CONFIRMED\nEND:VEVENT\nBEGIN:VEVENT\nSUMMARY:sem id\nDTSTART:20260101\nEND:VEVENT\nEND:VCALENDAR\n"))
    return ical.events(t.orders.select(text.alias("text"), F.lit("u").alias("url"))).select(
        "uid", "titulo", "data_inicio", "dia_inteiro", "situacao", "data_por_extenso")


@query("parse_menu", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS o FROM nation)
SELECT r_regionkey AS page_id, r_name AS title, 0 AS level, 1 AS ordem FROM region
UNION ALL SELECT n_regionkey, n_name, 1, o FROM n""")
def parse_menu(t):
    items = t.nation.groupBy("n_regionkey").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))),
        lambda x: F.concat(F.lit("<li><a href='/n'>"), x["n_name"], F.lit("</a></li>"))), "").alias("items"))
    rows = t.region.join(items, F.col("r_regionkey") == F.col("n_regionkey"))
    p = _pages(rows, "r_regionkey", "<ul><li><a href='/r'>", F.col("r_name"), "</a><ul>", F.col("items"), "</ul></li></ul>")
    return X.menu(elements.elements(p)).select("page_id", "title", "level", F.col("ordem").cast("int").alias("ordem"))
