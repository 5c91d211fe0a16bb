"""Records of whole pages as VARIANT columns.

One extractor per page kind joins the page's cards, sections and tables into one nested record, which keeps whatever
fields a page has and is read by path: `variant_get(record, '$.turmas_ofertadas[0].vagas', 'string')`. Every extractor
returns (page_id, titulo, embedding_text, record). Parts are aggregated per page before they are joined, so no join
multiplies rows; a page without any part keeps a record of NULLs. Missing fields are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import extract as X

# --- fixed values: labels of the pages and headings of the summary text -----------------
SUBJECT_CARDS = {
    "codigo": ("CÓDIGO", "Código", "Código da Disciplina"), "nome": ("Nome da Atividade", "Nome", "Disciplina"),
    "tipo_atividade": ("Tipo de Atividade",), "periodicidade": ("Periodicidade",), "creditos": ("CRÉDITOS", "Créditos"),
    "carga_horaria": ("Carga Horária",), "ch_teorica": ("CARGA HORÁRIA TEÓRICA",), "ch_pratica": ("CARGA HORÁRIA PRÁTICA",),
    "ch_obrigatoria": ("CARGA HORÁRIA OBRIGATÓRIA",), "freq_aprovacao": ("FREQUÊNCIA APROVAÇÃO",),
    "unidade_responsavel": ("Unidade responsável", "Unidade")}
SUBJECT_SECTIONS = {"ementa": ("Ementa",), "objetivos": ("Objetivos", "Objetivo"), "conteudo_programatico": ("Conteúdo Programático",),
                    "bibliografia": ("Bibliografia",)}
COURSE_CARDS = {
    "nome": ("Nome do Curso /Conceitos (*)", "Nome do Curso", "Nome"), "codigo_ufpel": ("Código UFPel", "Código"),
    "nivel": ("Nível / Grau", "Nível"), "modalidade": ("Modalidade",), "turno": ("Turno",), "codigo_emec": ("Código e-MEC",),
    "codigo_capes": ("Código CAPES",), "unidade": ("Unidade",), "programa": ("Programa",), "coordenador": ("Coordenador",),
    "criacao_reconhecimento": ("Criação e Reconhecimento",)}
COURSE_SUMMARY = (("\nSobre o curso:\n", ("Contextualização", "Apresentação")), ("\nObjetivos:\n", ("Objetivos", "Objetivo")),
                  ("\nPerfil do egresso:\n", ("Perfil do Egresso",)), ("\nÁrea de concentração:\n", ("Área de Concentração",)),
                  ("\nLinhas de pesquisa:\n", ("Linhas de Pesquisa",)))
RESPONSIBLE = r"(?i)respons[áa]vel|regente"
TEACHER_LABELS = r"Professor responsável pela turma:|Professor Regente:"


def _sections(els: DataFrame) -> DataFrame:
    """(page_id, sections): map from heading to text, of the information block if the page has one; of equal headings the last."""
    boxed = els.filter(F.col("id") == "informacoes").select("page_id").distinct()
    part = _inside(els, "informacoes").unionByName(els.join(boxed, "page_id", "left_anti"))
    last = X.accordion(part).groupBy("page_id", "section").agg(F.max_by("text", "ordem").alias("text"))
    return last.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "text"))).alias("sections"))


def _at(sections: Column, *names: str) -> Column:
    return F.coalesce(*[F.try_element_at(sections, F.lit(n)) for n in names])


def _list(rows: DataFrame, order: str, fields: list[str], name: str) -> DataFrame:
    """(page_id, name): the rows of each page as an ordered array of structs."""
    entry = F.struct(order, F.struct(*fields).alias("entry"))
    return rows.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"]).alias(name))


def _strings(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def _after_heading(els: DataFrame, pattern: str) -> DataFrame:
    """(page_id, tbl): the first table after the first heading that matches the normalised pattern."""
    heading = els.filter(F.col("tag").rlike("^h[1-6]$") & T.normalize("text").rlike(pattern)).groupBy("page_id").agg(F.min("pos").alias("head"))
    tables = els.filter(F.col("tag") == "table").select("page_id", F.col("pos").alias("tbl")).join(heading, "page_id").filter("tbl > head")
    return tables.groupBy("page_id").agg(F.min("tbl").alias("tbl"))


def _inside(els: DataFrame, name: str) -> DataFrame:
    """The elements below the first element of that id."""
    box = els.filter(F.col("id") == name).groupBy("page_id").agg(F.min_by("stop", "pos").alias("to"), F.min("pos").alias("from"))
    return els.join(box, "page_id").filter((F.col("pos") > F.col("from")) & (F.col("pos") <= F.col("to"))).drop("from", "to")


def subject_classes(els: DataFrame) -> DataFrame:
    """(page_id, row, turma, periodo, vagas, matriculados, curso, professores): rows under the heading of offered classes."""
    rows = X.table_rows(els).join(_after_heading(els, r"turmas\s+ofertadas"), ["page_id", "tbl"], "left_semi")
    cell = lambda i: X._or_null(F.get("cells", F.lit(i)))
    first = rows.groupBy("page_id", "tbl").agg(F.min("row").alias("row"))
    data = rows.join(first, ["page_id", "tbl", "row"], "left_anti").filter(F.size("cells") >= 4)
    return data.select("page_id", "row", cell(0).alias("turma"), cell(1).alias("periodo"), cell(2).alias("vagas"), cell(3).alias("matriculados"),
                       F.get(_strings(cell(4)), F.lit(0)).alias("curso"),
                       F.filter(_strings(F.coalesce(cell(5), F.lit(""))), lambda s: ~s.rlike(RESPONSIBLE)).alias("professores"))


def _record(base: DataFrame, fields: list[Column]) -> DataFrame:
    return base.withColumn("record", F.parse_json(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})))


def _parts(els: DataFrame, *more: DataFrame) -> DataFrame:
    """One row per page with its first heading, card, sections and further parts."""
    base = els.groupBy("page_id").agg(X._or_null(F.min_by("text", F.when(F.col("tag") == "h1", F.col("pos")))).alias("h1"))
    for part in (X.card_map(X.cards(els)), _sections(els), *more):
        base = base.join(part, "page_id", "left")
    return base


def subjects(els: DataFrame, courses: DataFrame | None = None) -> DataFrame:
    """Subject pages. courses: (page_id, course), the courses that a subject belongs to, by name in the record."""
    classes = _list(subject_classes(els), "row", ["turma", "periodo", "vagas", "matriculados", "curso", "professores"], "turmas_ofertadas")
    more = [classes]
    if courses is not None:
        more.append(courses.groupBy("page_id").agg(F.array_sort(F.collect_set("course")).alias("cursos_relacionados")))
    base = _parts(els, *more)
    if courses is None:
        base = base.withColumn("cursos_relacionados", F.array().cast("array<string>"))
    card, sections = F.col("card"), F.col("sections")
    named = {k: X.first_of(card, *v) for k, v in SUBJECT_CARDS.items()}
    named["nome"] = F.coalesce(named["nome"], F.col("h1"))
    told = {k: _at(sections, *v) for k, v in SUBJECT_SECTIONS.items()}
    used = F.array(*[F.lit(n) for names in SUBJECT_SECTIONS.values() for n in names])
    others = F.map_filter(F.coalesce(sections, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(used, k))
    lists = [F.coalesce("turmas_ofertadas", F.array()).alias("turmas_ofertadas"),
             F.coalesce("cursos_relacionados", F.array()).alias("cursos_relacionados"), others.alias("outras_secoes")]
    made = _record(base, [c.alias(k) for k, c in (named | told).items()] + lists)
    path = lambda p, kind="string": F.variant_get("record", f"$.{p}", kind)
    text = F.concat_ws("\n", F.concat(F.lit("Disciplina: "), F.coalesce(path("nome"), F.lit("")), F.lit(" (código "), F.coalesce(path("codigo"), F.lit("")),
                                      F.lit(") — UFPel")),
                       F.concat(F.lit("Ementa: "), path("ementa")), F.concat(F.lit("Objetivos: "), path("objetivos")),
                       F.when(F.size(path("cursos_relacionados", "array<string>")) > 0,
                              F.concat(F.lit("Cursos: "), F.array_join(path("cursos_relacionados", "array<string>"), ", "))))
    return made.select("page_id", path("nome").alias("titulo"), text.alias("embedding_text"), "record")


def course_matrix(els: DataFrame) -> DataFrame:
    """(page_id, row, entry): the curriculum's rows, each a map from header to cell with its semester and subject link."""
    part = _inside(els, "curriculo")
    labels = X._under_heading(part).select("page_id", "row", F.col("label").alias("semestre"))
    links = part.filter((F.col("tag") == "a") & F.col("href").contains("/disciplinas/")).select("page_id", "pos", "href")
    rows = part.filter(F.col("tag") == "tr").select("page_id", F.col("pos").alias("row"), F.col("stop").alias("row_stop"))
    linked = links.join(rows, "page_id").filter(F.col("pos").between(F.col("row"), F.col("row_stop"))).groupBy("page_id", "row").agg(F.min_by("href", "pos").alias("url"))
    found = X.table_records(part).join(labels.filter("semestre IS NOT NULL"), ["page_id", "row"]).join(linked, ["page_id", "row"], "left")
    full = found.filter(F.exists(F.map_values("record"), lambda v: v != ""))
    own = F.create_map(F.lit("semestre"), F.col("semestre"), F.lit("url"), F.col("url"))
    return full.select("page_id", "row", F.map_concat(F.map_filter("record", lambda k, v: ~k.isin("semestre", "url")), own).alias("entry"))


def course_people(els: DataFrame) -> DataFrame:
    """(page_id, row, nome, unidade, url): the people cells of the staff block."""
    part = _inside(els, "professores")
    cells = part.filter((F.col("tag") == "td") & X.has_class("h-card")).select("page_id", F.col("pos").alias("row"), F.col("stop").alias("to"))
    inner = part.select("page_id", "pos", "tag", "cls", "href", "text").join(cells, "page_id").filter((F.col("pos") > F.col("row")) & (F.col("pos") <= F.col("to")))
    pick = lambda *names: F.coalesce(*[F.min_by("text", F.when(X.has_class(n), F.col("pos"))) for n in names])
    made = inner.groupBy("page_id", "row").agg(
        X._or_null(pick("p-name", "tabela-detalhe-titulo")).alias("nome"), X._or_null(pick("p-org", "tabela-detalhe-info")).alias("unidade"),
        F.min_by("href", F.when((F.col("tag") == "a") & X.has_class("u-url"), F.col("pos"))).alias("url"))
    return made.filter("nome IS NOT NULL")


def course_classes(els: DataFrame) -> DataFrame:
    """(page_id, row, disciplina, disciplina_url, professores, turma, vagas, matriculados): rows that link a subject."""
    part = _inside(els, "turmas")
    rows = part.filter(F.col("tag") == "tr").select("page_id", F.col("pos").alias("row"), F.col("stop").alias("row_stop"))
    inner = part.select("page_id", "pos", "tag", "cls", "href", "text").join(rows, "page_id").filter((F.col("pos") > F.col("row")) & (F.col("pos") <= F.col("row_stop")))
    link = F.when((F.col("tag") == "a") & F.col("href").contains("/disciplinas/"), F.col("pos"))
    info = F.when((F.col("tag") == "span") & X.has_class("tabela-detalhe-info") & (F.trim("text") != ""), F.struct("pos", "text"))
    told = inner.groupBy("page_id", "row").agg(F.min_by("text", link).alias("disciplina"), F.min_by("href", link).alias("disciplina_url"),
                                               F.array_sort(F.collect_list(info)).alias("info")).filter("disciplina IS NOT NULL")
    cells = X.table_rows(part).filter(F.size("cells") >= 2).select("page_id", "row", "cells")
    last = lambda k: X._or_null(F.get("cells", F.greatest(F.size("cells") - 3, F.lit(0)) + k))
    people = F.transform("info", lambda s: F.trim(F.regexp_replace(s["text"], TEACHER_LABELS, "")))
    return told.join(cells, ["page_id", "row"]).select("page_id", "row", "disciplina", "disciplina_url", people.alias("professores"),
                                                       last(0).alias("turma"), last(1).alias("vagas"), last(2).alias("matriculados"))


def courses(els: DataFrame) -> DataFrame:
    """Course pages: cards, sections, curriculum, staff and offered classes."""
    matrix = course_matrix(els).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", F.map_entries("entry").alias("e")))),
                                                                  lambda x: F.map_from_entries(x["e"])).alias("matriz_curricular"))
    staff = _list(course_people(els), "row", ["nome", "unidade", "url"], "professores")
    classes = _list(course_classes(els), "row", ["disciplina", "disciplina_url", "professores", "turma", "vagas", "matriculados"], "turmas_ofertadas")
    base = _parts(els, matrix, staff, classes)
    named = {k: X.first_of(F.col("card"), *v) for k, v in COURSE_CARDS.items()}
    named["nome"] = F.coalesce(named["nome"], F.col("h1"))
    lists = [F.coalesce(n, F.array()).alias(n) for n in ("matriz_curricular", "professores", "turmas_ofertadas")]
    made = _record(base, [c.alias(k) for k, c in named.items()] + [F.coalesce("sections", F.create_map().cast("map<string,string>")).alias("informacoes"), *lists])
    path = lambda p: F.variant_get("record", f"$.{p}", "string")
    say = lambda p: F.coalesce(path(p), F.lit(""))
    text = F.concat_ws(
        "\n", F.concat(F.lit("Curso: "), say("nome"), F.lit(" — UFPel")),
        F.concat(F.lit("Nível: "), say("nivel"), F.lit(" | Modalidade: "), say("modalidade"), F.lit(" | Turno: "), say("turno")),
        F.concat(F.lit("Unidade responsável: "), say("unidade")), F.concat(F.lit("Coordenador: "), say("coordenador")),
        F.concat(F.lit("Programa: "), path("programa")),
        *[F.concat(F.lit(head), _at(F.col("sections"), *names)) for head, names in COURSE_SUMMARY])
    return made.select("page_id", F.concat(say("nome"), F.lit(" ("), say("nivel"), F.lit(")")).alias("titulo"), text.alias("embedding_text"), "record")
