import datetime as dt

import pytest
from pyspark.sql import functions as F

from vereda.functions import html as H
from vereda.operators import extract as X
from vereda.sources import elements, ical


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_html_text(spark):
    html = ("<body><h2>Título</h2><p>Um <a href='/x'>link</a>.</p><ul><li>a</li><li>b &amp; c</li></ul><script>x</script>"
            "<table><tr><th>Req</th><th>Prazo</th></tr><tr><td>20 créditos</td><td>3º</td></tr></table><p>l1<br>l2</p></body>")
    got = pages(spark, html).select(H.to_text("html")).first()[0]
    assert got == "Título\nUm link.\n- a\n- b & c\nReq | Prazo\n20 créditos | 3º\nl1\nl2"


def test_urls(spark):
    base = "https://wp.ufpel.edu.br/computacao/a/b"
    cases = {"../c.pdf": "https://wp.ufpel.edu.br/computacao/c.pdf", "/x?y=1": "https://wp.ufpel.edu.br/x?y=1",
             "d": "https://wp.ufpel.edu.br/computacao/a/d", "//h.br/p": "https://h.br/p", "mailto:a@b.c": "mailto:a@b.c",
             "./e/": "https://wp.ufpel.edu.br/computacao/a/e/"}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    got = {r["h"]: r["u"] for r in df.select("h", H.absolute(F.col("h"), F.lit(base)).alias("u")).collect()}
    assert got == cases
    kinds = {"mailto:x@y.z": "email", "https://h.br/f%20a.PDF": "documento", "https://h.br/f.xlsx": "planilha",
             "https://h.br/i.png": "imagem", "https://wp.ufpel.edu.br/p": "interno", "https://h.br/": "externo", "/rel": "interno"}
    df = spark.createDataFrame([(k,) for k in kinds], "h string")
    assert {r["h"]: r["k"] for r in df.select("h", H.link_class(F.col("h")).alias("k")).collect()} == kinds


def test_sections(spark):
    html = ("<p>antes</p><p><a name='mat'></a></p><p><strong>COMO FAZER A MATRÍCULA?</strong></p><p>Assim.</p>"
            "<h3 id='x'>Outra</h3><ul><li>item</li></ul><p><b>Obs:</b></p>")
    got = [(s["title"], s["level"], s["anchor"], s["text"]) for s in pages(spark, html).select(H.sections("html").alias("s")).first()["s"]]
    assert got == [(None, 0, None, "antes"), ("COMO FAZER A MATRÍCULA?", 4, "mat", "Assim."), ("Outra", 3, "x", "- item\nObs:")]


def test_cards(spark):
    html = ("<div class='ficha-dados'><div class='v'><span class='ficha-label'>Cargo:</span><span class='ficha-campo'>Professor</span></div>"
            "<div class='v'><span class='ficha-label'>Unidade (*):</span><span class='ficha-campo'><a href='/unidades/id/7'>CDTec</a></span></div>"
            "<div class='vinculo oculta-exibe'><span class='ficha-label'>Lotação:</span><span class='ficha-campo'>velha</span></div>"
            "<div><span class='ficha-label'>Cargo:</span><span class='ficha-campo'>Antigo</span></div></div>")
    c = X.cards(elements.elements(pages(spark, html)))
    assert sorted(rows(c, "key", "value", "href")) == [("cargo", "Professor", None), ("unidade", "CDTec", "/unidades/id/7")]
    card = X.card_map(c).select(X.first_of(F.col("card"), "Função", "Cargo")).first()[0]
    assert card == "Professor"


def test_tables_and_schedule(spark):
    html = ("<table class='grade-horarios'><tr><th>Manhã</th><th>Tarde</th></tr><tr><td><span>SEG</span> 08:00 - 09:40 <span></span> 10:00 - 11:40"
            "<span>QUA</span> 8:00-9:40</td><td><span>SÁB</span> 13:30 - 15:10</td></tr></table>")
    els = elements.elements(pages(spark, html))
    got = rows(X.schedule(els).orderBy("ordem"), "period", "day", "begin", "end")
    assert got == [("Manhã", "SEG", "08:00", "09:40"), ("Manhã", "SEG", "10:00", "11:40"), ("Manhã", "QUA", "08:00", "09:40"),
                   ("Tarde", "SAB", "13:30", "15:10")]
    nested = "<table><tr><th>A</th><th>B</th></tr><tr><td>1<table><tr><td>x</td></tr></table></td><td>2</td></tr></table>"
    recs = X.table_records(elements.elements(pages(spark, nested))).collect()
    assert len(recs) == 1 and recs[0]["record"]["B"] == "2"


def test_calendar(spark):
    def line(day, text):
        return (f"<div class='cobalto-calendario-linha'><span class='cobalto-calendario-tipo' title='Feriados'></span>"
                f"<span class='cobalto-calendario-dia'>{day}</span><span class='cobalto-calendario-descricao'>{text}</span></div>")
    html = line("01", "sem mês") + "<div class='cobalto-calendario-mes'>Fevereiro / 2022</div>" + line("15 - Ter", "Início") + line("30", "inválida")
    got = rows(X.calendar(elements.elements(pages(spark, html))), "day", "text", "kind")
    assert got == [(dt.date(2022, 2, 15), "Início", "Feriados")]


def test_faq(spark):
    a = ("<h3 id='m'>Matrícula:</h3><p><strong>Pergunta:</strong> Como peço?</p><p>Resposta: Assim.</p><ul><li>um</li></ul>"
         "<p><b>TCC</b></p><p>Pergunta: Sem resposta?</p><p>Pergunta: Outra?</p><p>Resposta: Sim</p>")
    b = "<h2>Assunto</h2><p><a name='q1'></a></p><p><strong>QUANDO É?</strong></p><p>Em março.</p>"
    p = pages(spark, a, b)
    got = X.faq(p, elements.elements(p)).orderBy("page_id", "ordem")
    assert rows(got, "page_id", "ordem", "subject", "question", "answer") == [
        (0, 0, "Matrícula", "Como peço?", "Assim.\n- um"), (0, 1, "TCC", "Outra?", "Sim"), (1, 0, "Assunto", "QUANDO É?", "Em março.")]
    assert got.filter("page_id = 1").first()["anchor"] == "q1"


def test_people_and_groups(spark):
    html = ("<p><strong>Docentes</strong></p><ul><li><a href='https://institucional.ufpel.edu.br/servidores/id/12'>Ana Souza</a> "
            "<a href='http://lattes.cnpq.br/1'>Lattes</a></li></ul><p><b>Técnicos</b></p><ul><li>Secretaria:</li>"
            "<li>Apoio: <a href='https://x.br/p'>Bruno Lima</a></li></ul>")
    got = rows(X.people(elements.elements(pages(spark, html))).orderBy("name"), "name", "category", "sector", "staff_id", "cv", "profile")
    assert got == [("Ana Souza", "docente", None, "12", "http://lattes.cnpq.br/1", None),
                   ("Bruno Lima", "tecnico_administrativo", "Apoio", None, None, "https://x.br/p")]
    g = X.groups(elements.elements(pages(spark, "<ul><li><a href='/g'>Grupo de Redes (GRED)</a></li><li><a href='/h'>curto</a></li></ul>")))
    assert rows(g, "name", "acronym", "url") == [("Grupo de Redes (GRED)", "GRED", "/g")]


def test_programme_pages(spark):
    req = ("<p>Requisitos para alunos de mestrado</p><table><tr><td>REQUISITOS OBRIGATÓRIOS</td><td>PRAZO</td></tr><tr><td>20 créditos</td><td>2 anos</td></tr>"
           "<tr><td>Requisitos opcionais</td><td>PRAZO</td></tr><tr><td>Estágio</td><td></td></tr></table>")
    got = rows(X.requirements(elements.elements(pages(spark, req))), "level", "requirement", "deadline", "mandatory")
    assert sorted(got) == [("mestrado", "20 créditos", "2 anos", True), ("mestrado", "Estágio", None, False)]
    sub = "<ul><li><strong>Visão (4 créditos)</strong><br>Disponível para aluno especial? Sim<br>Responsável: Ana<br>Ementa: imagens</li></ul>"
    assert rows(X.subjects(elements.elements(pages(spark, sub))), "name", "credits", "aluno_especial", "responsavel", "ementa", "horario") == [
        ("Visão", 4, True, "Ana", "imagens", None)]
    d = "<p>Defesas de tese</p><p>Ana, 16 de Abril de 2026, 14h00</p><p>Bia, 31 de Abril de 2026</p>"
    assert rows(X.defences(elements.elements(pages(spark, d))), "kind", "student", "day", "hour") == [("tese", "Ana", dt.date(2026, 4, 16), "14:00")]
    lines = "<p><a href='/ppgc/linhas/fundamentos/'>Fundamentos</a></p><p>Texto um.</p><p>Texto dois.</p><h3>fim</h3><p>fora</p>"
    assert rows(X.research_lines(elements.elements(pages(spark, lines))), "slug", "name", "description") == [("fundamentos", "Fundamentos", "Texto um.\nTexto dois.")]


def test_institutional_pages(spark):
    bib = "<p><strong>Bibliografia Básica:</strong></p><ul><li>Livro A</li></ul><p><strong>Complementar</strong></p><ul><li>Livro B</li></ul>"
    assert rows(X.bibliography(elements.elements(pages(spark, bib))), "kind", "reference", "ordem") == [("basica", "Livro A", 1), ("complementar", "Livro B", 2)]
    seats = ("<table class='tabela-fixed'><tr><th></th><th></th><th>AC</th><th>Total</th></tr><tr><td>SISU 2026/1</td><td>30</td><td>40</td></tr></table>")
    assert sorted(rows(X.seats(elements.elements(pages(spark, seats))), "process", "year", "semester", "quota", "seats")) == [
        ("SISU", 2026, 1, "AC", 30), ("SISU", 2026, 1, "TOTAL", 40)]
    ind = "<span class='curso-conceito'><span class='curso-conceito-nome'>Enade (2021)</span><span class='curso-conceito-nota'>4</span></span>"
    assert rows(X.indicators(elements.elements(pages(spark, ind))), "indicator", "year", "grade") == [("Enade", 2021, "4")]
    leg = "<p>Formas de ingresso</p><table><tr><td>AC</td><td>Ampla concorrência</td></tr></table>"
    assert rows(X.legend(elements.elements(pages(spark, leg))), "acronym", "description") == [("AC", "Ampla concorrência")]
    df = spark.createDataFrame([("Doutorado em Oceanografia (FURG, 2019)",), ("texto livre",)], "s string")
    assert [(r["d"]["level"], r["d"]["institution"], r["d"]["year"]) for r in df.select(X.degree("s").alias("d")).collect()] == [("Doutorado", "FURG", 2019), (None, None, None)]


def test_curriculum_and_classes(spark):
    cur = ("<h3 class='cor-fundo'>2º Semestre</h3><div data-content='1'><table><tr><th>Código</th><th>Disciplina / Pré-requisitos</th><th>Cr.</th><th>Caráter</th></tr>"
           "<tr><td><a href='/disciplinas/cod/22'>22</a></td><td><a href='/disciplinas/cod/22'>Redes</a><span class='tabela-detalhe-info'>2200 - ALGORITMOS<br>2201 - CÁLCULO</span></td><td>4</td><td>Obrig.</td></tr></table></div>")
    matrix, pre = X.curriculum(elements.elements(pages(spark, cur)))
    assert rows(matrix, "code", "block", "semester", "credits", "kind", "ordem") == [("22", "semestre", 2, 4, "Obrig.", 1)]
    assert sorted(rows(pre, "requires", "requires_name")) == [("2200", "ALGORITMOS"), ("2201", "CÁLCULO")]
    row = ("<tr><td><a href='/disciplinas/cod/22'>Redes</a><span class='tabela-detalhe-info'>Professor responsável pela turma: ANA SOUZA</span></td><td>M1</td><td>30</td><td>28</td></tr>")
    off = "<h3>2026 / 1</h3>" + "".join(
        f"<div class='versao'><h4>Versão do Currículo: {v}</h4><h4 class='cor-fundo'>3º Semestre</h4><table class='tabela-dados'>{row}</table></div>" for v in ("1028 (ATUAL)", "1001"))
    out = X.offered_classes(elements.elements(pages(spark, off)))
    assert rows(out["classes"], "class_id", "seats", "enrolled") == [("22-2026-1-M1", 30, 28)]
    assert sorted(rows(out["versions"], "version", "current", "semester")) == [("1001", False, 3), ("1028", True, 3)]
    assert rows(out["teachers"], "name", "role") == [("ANA SOUZA", "responsavel")]


def test_menu(spark):
    html = "<ul><li><a href='/g'>Graduação</a><ul><li><a href='/s'>Semana</a></li></ul></li><li><a href='/p'>Pós</a></li></ul>"
    got = rows(X.menu(elements.elements(pages(spark, html))).orderBy("item"), "title", "level", "ordem")
    assert got == [("Graduação", 0, 1), ("Semana", 1, 1), ("Pós", 0, 2)]


ICS = ("BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:1@x\nSUMMARY:Prazo de matr\n ícula\\, aviso\nDTSTART;VALUE=DATE:20260715\nDTEND;VALUE=DATE:20260716\nSTATUS:CONFIRMED\nEND:VEVENT\n"
       "BEGIN:VEVENT\nUID:2@x\nSUMMARY:Defesa\nDTSTART:20260801T140000Z\nDTEND:20260801T160000Z\nEND:VEVENT\nBEGIN:VEVENT\nSUMMARY:sem id\nDTSTART:20260101\nEND:VEVENT\nEND:VCALENDAR\n")


def test_ical(spark):
    df = spark.createDataFrame([(ICS, "u")], "text string, url string")
    got = rows(ical.events(df).orderBy("uid"), "uid", "titulo", "data_inicio", "data_fim", "dia_inteiro", "hora_inicio", "situacao", "data_por_extenso")
    assert got == [("1@x", "Prazo de matrícula, aviso", dt.date(2026, 7, 15), dt.date(2026, 7, 15), True, None, "confirmed", "15 de julho de 2026"),
                   ("2@x", "Defesa", dt.date(2026, 8, 1), dt.date(2026, 8, 1), False, "14:00:00", None, "1 de agosto de 2026")]
    html = ("<iframe src='https://calendar.google.com/calendar/embed?src=cHQuYnIjaG9saWRheUBncm91cA&#038;src=YWdlbmRhQGV4YW1wbGUub3Jn'></iframe>")
    assert pages(spark, html).select(ical.calendar_id("html")).first()[0] == "agenda@example.org"
