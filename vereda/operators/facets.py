"""Facet texts of each entity: a self-describing card plus one text per section.

Lookups are aggregated per entity and left-joined (unique keys), then the cards
are cut into pieces by `chunk.facets` or `chunk.portal_facets`. Every builder
takes a mapping of tables and returns `source` plus the facet columns. Columns of
card and metadata that a table lacks read as NULL. Metadata are maps of texts, lists
in JSON.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import chunk

Tables = Mapping[str, DataFrame]

# Labels shown in the texts.
UNKNOWN = "não informado"
PROGRAMME = "PPGC — Programa de Pós-Graduação em Computação da UFPel"
NOTICE_NAMES = {
    "ingresso_regular": "seleção de estudante regular (mestrado/doutorado)",
    "ingresso_especial": "seleção de estudante especial (disciplinas isoladas)",
    "bolsa_classificacao": "edital interno de classificação para bolsas",
    "bolsa_sanduiche": "bolsa de doutorado sanduíche no exterior (PDSE/CAPES)",
    "bolsa_posdoc": "bolsa de pós-doutorado", "professor_visitante": "seleção de professor visitante",
    "dinter": "doutorado interinstitucional (DInter)",
    "resultado": "resultado / homologação de processo seletivo", "outro": "edital"}
LEVEL_NAMES = {"mestrado": "Mestrado", "doutorado": "Doutorado", "ambos": "Mestrado e Doutorado",
               "posdoc": "Pós-doutorado", "docente": "Docente"}
DOCUMENT_NAMES = {"edital": "Edital", "retificacao": "Retificação", "formulario": "Formulário", "resultado": "Resultado",
                  "cronograma": "Cronograma", "anexo": "Anexo", "outro": "Documento"}
NORM_NAMES = {"resolucao": "Resolução", "portaria": "Portaria", "regimento": "Regimento",
              "planejamento_estrategico": "Planejamento Estratégico", "outro": "Norma"}
SUBJECT_NAMES = {"edital": "edital / processo seletivo", "defesa": "defesa de dissertação ou tese", "bolsa": "bolsas",
                 "matricula": "matrícula e oferta de disciplinas", "avaliacao": "avaliação CAPES",
                 "evento": "evento acadêmico", "geral": "geral"}
COURSE_OF_SCOPE = {"ccomp": "Ciência da Computação", "ecomp": "Engenharia de Computação",
                   "ambos": "Ciência da Computação e Engenharia de Computação"}
# Page categories that have tables, and so facets, of their own.
NORMALISED = ("edital", "normativo", "linha_pesquisa", "disciplinas")


def _full(df: DataFrame, *names: str) -> DataFrame:
    """df with the named text columns, NULL where it has none."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def _meta(kind: str, corpus: str | None = None, **fields) -> Column:
    """Metadata of a facet: its kind, its corpus, and each field's value (NULL where there is none)."""
    values = {"tipo": F.lit(kind)} | ({"acervo": F.lit(corpus)} if corpus else {}) | {k: T._col(v).cast("string") for k, v in fields.items()}
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def _list(c) -> Column:
    """A list as JSON text, an absent one as the empty list."""
    return F.to_json(F.coalesce(T._col(c), F.array().cast("array<string>")))


def _known(c) -> Column:
    return F.coalesce(F.nullif(T._col(c).cast("string"), F.lit("")), F.lit(UNKNOWN))


def _named(c, names: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.try_element_at(m, T._col(c))


def _ordered(df: DataFrame, key: str, label: Column, order: list[Column], out: str) -> DataFrame:
    """Labels of each key in order, as a list."""
    row = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], label.alias("l"))
    kept = df.filter(label.isNotNull() & (label != ""))
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(row)), lambda s: s["l"]).alias(out))


def _joined(df: DataFrame, key: str, label: Column, order: list[Column], out: str, sep: str) -> DataFrame:
    """Labels of each key in order, joined to one string."""
    return _ordered(df, key, label, order, out).withColumn(out, F.array_join(out, sep))


def _distinct(df: DataFrame, key: str, label: Column, out: str) -> DataFrame:
    """Distinct labels of each key in their own order, as a list."""
    pairs = df.select(key, label.alias("__l")).filter(F.col("__l").isNotNull()).distinct()
    return pairs.groupBy(key).agg(F.array_sort(F.collect_set("__l")).alias(out))


def _sections(entities: DataFrame, key: str, sections: DataFrame, section_key: str, cut) -> DataFrame:
    s = _full(sections, "secao").select(F.col(section_key).alias(key), "secao", "secao_slug", "texto").join(
        entities.select(key, "label", "url", "meta"), key)
    return cut(s, key, scope=F.col("secao_slug"), title=F.concat_ws(" — ", "label", "secao"), text=F.col("texto"), url=F.col("url"),
               metadata=F.map_concat("meta", F.create_map(F.lit("secao"), "secao")))


def _tag(source: str, *frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).select(F.lit(source).alias("source"), "*")


def courses(t: Tables) -> DataFrame:
    grade = _joined(t["curso_conceito"], "curso_codigo", F.concat_ws(" ", "indicador", F.format_string("(%s): %s", F.col("ano").cast("string"), "nota")),
                    [F.col("indicador"), F.col("ano")], "conceitos", "; ")
    places = t["curso_vaga"].filter(F.col("cota") != "TOTAL").groupBy("curso_codigo", "processo", "ano", "semestre").agg(F.sum("vagas").alias("n"))
    seats = _joined(places, "curso_codigo", F.format_string("%s %s/%s: %d", "processo", F.col("ano").cast("string"), F.col("semestre").cast("string"), "n"),
                    [F.col("ano"), F.col("semestre"), F.col("processo")], "vagas", "; ")
    c = _full(t["curso"], "nivel", "grau", "modalidade", "turno", "unidade_nome", "coordenador_nome", "programa", "codigo_emec", "codigo_capes", "url")
    c = (c.withColumn("curso_codigo", F.col("codigo_ufpel")).join(grade, "curso_codigo", "left").join(seats, "curso_codigo", "left")
         .withColumn("label", F.format_string("Curso %s (%s)", "nome", F.coalesce("grau", "nivel", F.lit("")))))
    c = c.withColumn("meta", _meta("curso", curso_codigo="curso_codigo", nivel="nivel", grau="grau", modalidade="modalidade", unidade="unidade_nome"))
    code = F.concat_ws(" | ", F.concat(F.lit("Código UFPel: "), "curso_codigo"), T.labelled("Código e-MEC", "codigo_emec"), T.labelled("Código CAPES", "codigo_capes"))
    card = T.join_lines(
        F.concat(F.lit("Nível: "), _known("nivel"), F.lit(" | Grau: "), _known("grau")),
        F.concat(F.lit("Modalidade: "), _known("modalidade"), F.lit(" | Turno: "), _known("turno")),
        F.concat(F.lit("Unidade responsável: "), _known("unidade_nome")), F.concat(F.lit("Coordenador: "), _known("coordenador_nome")),
        T.labelled("Programa", "programa"), code, T.labelled("Conceitos", "conceitos"), T.labelled("Vagas", "vagas"))
    cards = chunk.facets(c, "curso_codigo", scope=F.lit("ficha"), title=F.col("label"), text=card, url=F.col("url"), metadata=F.col("meta"))
    return _tag("curso", cards, _sections(c, "curso_codigo", t["curso_info_secao"], "curso_codigo", chunk.facets))


def subjects(t: Tables) -> DataFrame:
    names = t["curso"].select(F.col("codigo_ufpel").alias("curso_codigo"), F.col("nome").alias("curso_nome"))
    placed = t["curso_matriz"].select("curso_codigo", F.col("disciplina_codigo").alias("codigo"), "semestre_rotulo", "carater").join(names, "curso_codigo")
    offers = _distinct(placed, "codigo", F.format_string("%s (%s, %s)", "curso_nome", "semestre_rotulo", "carater"), "oferta")
    courses_of = _distinct(placed, "codigo", F.col("curso_nome"), "cursos")
    syllabus = t["disciplina_conteudo"].filter(F.col("secao_slug") == "ementa").select(F.col("disciplina_codigo").alias("codigo"), F.col("texto").alias("ementa"))
    d = (_full(t["disciplina"], "creditos", "carga_horaria", "unidade_nome", "tipo_atividade", "periodicidade", "url")
         .join(offers, "codigo", "left").join(courses_of, "codigo", "left").join(syllabus, "codigo", "left")
         .withColumn("label", F.format_string("Disciplina %s (código %s)", "nome", "codigo"))
         .withColumn("meta", _meta("disciplina", disciplina_codigo="codigo", cursos=_list("cursos"), unidade="unidade_nome", creditos="creditos")))
    card = T.join_lines(
        F.concat(F.lit("Créditos: "), _known("creditos"), F.lit(" | Carga horária: "), _known("carga_horaria"), F.lit(" horas")),
        F.concat(F.lit("Tipo: "), _known("tipo_atividade"), F.lit(" | Periodicidade: "), _known("periodicidade")),
        F.concat(F.lit("Unidade responsável: "), _known("unidade_nome")), T.labelled("Ofertada em", F.array_join("oferta", "; ")), T.labelled("Ementa", "ementa"))
    cards = chunk.facets(d, "codigo", scope=F.lit("ficha"), title=F.col("label"), text=card, url=F.col("url"), metadata=F.col("meta"))
    return _tag("disciplina", cards, _sections(d, "codigo", t["disciplina_conteudo"], "disciplina_codigo", chunk.facets))


def staff(t: Tables) -> DataFrame:
    names = t["curso"].select(F.col("codigo_ufpel").alias("curso_codigo"), F.col("nome").alias("curso_nome"))
    courses_of = _distinct(t["servidor_curso"].join(names, "curso_codigo"), "servidor_id", F.col("curso_nome"), "cursos")
    areas = _ordered(t["servidor_area_atuacao"], "servidor_id", F.col("area"), [F.col("ordem")], "areas")
    degrees = _joined(t["servidor_formacao"], "servidor_id", F.concat(F.lit("  - "), "texto_original"), [F.col("ordem")], "formacao", "\n")
    led = t["servidor_projeto"].join(t["projeto"].select("projeto_id", "titulo", "enfase"), "projeto_id")
    role = F.when(F.col("papel").isNotNull(), F.concat(F.lit(", "), F.lower("papel"))).otherwise("")
    projects = _ordered(led, "servidor_id", F.concat(F.lit("  - "), "titulo", F.lit(" ("), F.coalesce("enfase", F.lit("ênfase não informada")), role, F.lit(")")),
                        [F.col("titulo")], "projetos")
    s = _full(t["servidor"], "cargo", "titulacao", "lotacao_nome", "regime_jornada", "curriculo_resumo", "url")
    for part in (courses_of, areas, degrees, projects):
        s = s.join(part, "servidor_id", "left")
    s = s.withColumn("label", F.concat(F.lit("Professor(a) "), "nome")).withColumn("meta", _meta(
        "servidor", servidor_id="servidor_id", cursos=_list("cursos"), lotacao="lotacao_nome", titulacao="titulacao", areas=_list("areas"),
        vinculo_ativo=F.coalesce("vinculo_ativo", F.lit(True))))
    ended = F.when(F.coalesce("vinculo_ativo", F.lit(True)), F.lit(None).cast("string")).when(
        F.col("data_saida_cargo").isNotNull(), F.concat(F.lit("Vínculo NÃO corrente: encerrado em "), F.col("data_saida_cargo").cast("string"), F.lit("."))
    ).otherwise("Vínculo NÃO corrente na UFPel.")
    card = T.join_lines(
        F.concat(F.lit("Cargo: "), _known("cargo"), F.lit(" | Titulação: "), _known("titulacao")), F.concat(F.lit("Lotação: "), _known("lotacao_nome")),
        T.labelled("Regime", "regime_jornada"), ended, T.labelled("Professor(a) dos cursos de Computação", F.array_join("cursos", ", ")),
        T.labelled("Áreas de atuação", F.array_join("areas", "; ")))

    listed = F.array_join(F.transform("areas", lambda a: F.concat(F.lit("  - "), a)), "\n")
    led_by = F.map_concat("meta", F.create_map(F.lit("n_projetos"), F.coalesce(F.size("projetos"), F.lit(0)).cast("string")))

    def part(scope: str, suffix: str | None, text: Column, meta: Column = F.col("meta")) -> Column:
        title = F.concat(F.col("label"), F.lit(f" — {suffix}")) if suffix else F.col("label")
        return F.struct(F.lit(scope).alias("scope"), title.alias("title"), text.alias("text"), meta.alias("meta"))

    # The joins of a person are read once, whatever the number of texts made of them.
    parts = F.array(part("ficha", None, card), part("curriculo_resumo", "Resumo do currículo", F.col("curriculo_resumo")),
                    part("areas_atuacao", "Áreas de atuação e pesquisa", listed), part("formacao", "Formação acadêmica", F.col("formacao")),
                    part("projetos", "Projetos vigentes", F.array_join("projetos", "\n"), led_by))
    each = s.select("servidor_id", "url", F.explode(parts).alias("part"))
    return _tag("servidor", chunk.facets(each, "servidor_id", scope=F.col("part.scope"), title=F.col("part.title"), text=F.col("part.text"),
                                         url=F.col("url"), metadata=F.col("part.meta")))


def projects(t: Tables) -> DataFrame:
    team = _distinct(t["servidor_projeto"].join(t["servidor"].select("servidor_id", "nome"), "servidor_id"), "projeto_id", F.col("nome"), "equipe")
    p = _full(t["projeto"], "enfase", "area_cnpq", "coordenador_nome", "unidade_origem", "data_inicio", "data_fim", "resumo", "url")
    p = p.join(team, "projeto_id", "left").withColumn("label", F.concat(F.lit("Projeto "), "titulo"))
    p = p.withColumn("meta", _meta("projeto", projeto_id="projeto_id", enfase="enfase", area_cnpq="area_cnpq", unidade="unidade_origem", professores=_list("equipe")))
    card = T.join_lines(
        F.concat(F.lit("Ênfase: "), _known("enfase"), F.lit(" | Área CNPq: "), _known("area_cnpq")), F.concat(F.lit("Coordenador: "), _known("coordenador_nome")),
        F.concat(F.lit("Unidade de origem: "), _known("unidade_origem")),
        F.concat(F.lit("Vigência: "), F.coalesce(F.col("data_inicio").cast("string"), F.lit("?")), F.lit(" a "), F.coalesce(F.col("data_fim").cast("string"), F.lit("sem data final"))),
        T.labelled("Professores envolvidos", F.array_join("equipe", ", ")), T.labelled("Resumo", "resumo"))
    cards = chunk.facets(p, "projeto_id", scope=F.lit("ficha"), title=F.col("label"), text=card, url=F.col("url"), metadata=F.col("meta"))
    return _tag("projeto", cards, _sections(p, "projeto_id", t["projeto_info_secao"], "projeto_id", chunk.facets))


def classes(t: Tables) -> DataFrame:
    from . import views
    # A class of an unknown subject is named by the subject's code.
    known = _full(t["disciplina"], "creditos", "carga_horaria", "url").select("codigo", "nome", "creditos", "carga_horaria", "url")
    code = t["turma"].select(F.col("disciplina_codigo").alias("codigo")).filter("codigo IS NOT NULL").distinct().join(known.select("codigo"), "codigo", "left_anti")
    subjects_of = known.unionByName(code.withColumn("nome", F.col("codigo")), allowMissingColumns=True)
    seen = {n: t[n] for n in ("turma", "turma_horario", "turma_curriculo", "turma_professor", "curso")}
    v = views.vw_turma(seen | {"disciplina": subjects_of}).join(known.select(F.col("codigo").alias("disciplina_codigo"), "url"), "disciplina_codigo", "left")
    meta = _meta("turma", turma_id="turma_id", disciplina_codigo="disciplina_codigo", ano="ano", semestre="semestre", cursos=_list("cursos"), versoes=_list("versoes"))
    title = F.format_string("Turma %s de %s (%s/%s)", "codigo_turma", "disciplina_nome", F.col("ano").cast("string"), F.col("semestre").cast("string"))
    text = T.join_lines(
        F.format_string("Disciplina: %s (código %s)", "disciplina_nome", "disciplina_codigo"), T.labelled("Ofertada para", F.array_join("cursos", "; ")),
        T.labelled("Professores", F.array_join("professores", ", ")), T.labelled("Horários", "horarios"),
        F.concat(F.lit("Vagas: "), _known("vagas"), F.lit(" | Matriculados: "), _known("matriculados")))
    return _tag("turma", chunk.facets(v, "turma_id", scope=F.lit("oferta"), title=title, text=text, url=F.col("url"), metadata=meta))


def portal_posts(t: Tables) -> DataFrame:
    from . import views
    v = views.vw_port_noticia(t).join(_full(t["port_post"], "texto", "secao_slug").select("post_id", "texto", "secao_slug"), "post_id")
    meta = _meta("noticia", "portal", ano="ano", mes="mes", data="data_publicacao", secao="secao_slug", escopo_curso="escopo_curso", categorias=_list("categorias"))
    head = T.join_lines(F.lit("Notícia do portal da Computação-UFPel"), T.labelled("Título", "titulo"), T.labelled("Publicada em", "data_por_extenso"),
                        T.labelled("Curso", _named("escopo_curso", COURSE_OF_SCOPE)), T.labelled("Categorias", F.array_join("categorias", ", ")), T.labelled("Palavras-chave", F.array_join("tags", ", ")), T.labelled("Autor", "autor"))
    text = F.concat(head, F.lit("\n\n"), F.coalesce("texto", "resumo", F.lit("")))
    return _tag("portal_noticia", chunk.portal_facets(v, "post_id", scope=F.lit("noticia"), title=F.col("titulo"), text=text, url=F.col("url"),
                                                      metadata=meta))


def portal_pages(t: Tables) -> DataFrame:
    """A card only for pages with several sections, and one text per section."""
    pages = t["port_pagina"].join(t["port_secao"].select("secao_slug", F.col("nome").alias("secao_nome")), "secao_slug", "left")
    many = t["port_pagina_secao"].groupBy("pagina_id").agg(F.count("*").alias("n")).filter("n > 1").select("pagina_id")
    path = T.readable_path("caminho")
    card = T.join_lines(F.lit("Página do portal da Computação-UFPel"), T.labelled("Título", "titulo"), T.labelled("Seção", "secao_nome"),
                        T.labelled("Caminho no site", path), F.when(F.col("idioma") == "en", "Idioma: inglês"), T.labelled("Atualizada em", "data_modificacao"), F.col("resumo"))
    cards = chunk.portal_facets(pages.join(many, "pagina_id"), "pagina_id", scope=F.lit("ficha"), title=F.col("titulo"), text=card, url=F.col("url"),
                                metadata=_meta("pagina_ficha", "portal", secao="secao_slug", idioma="idioma", caminho="caminho"))
    s = _full(t["port_pagina_secao"], "ancora").withColumnRenamed("url", "secao_url").join(
        pages.select("pagina_id", "titulo", "secao_nome", "secao_slug", "idioma", "caminho", "data_modificacao"), "pagina_id")
    text = T.join_lines(F.concat(F.lit("Portal da Computação-UFPel — "), F.coalesce("secao_nome", F.lit("site"))), T.labelled("Página", "titulo"),
                        T.labelled("Seção", "titulo_secao"), T.labelled("Caminho no site", path), T.labelled("Atualizada em", "data_modificacao"), F.col("texto"))
    per = chunk.portal_facets(s, "pagina_id", scope=F.concat(F.lit("secao#"), F.col("ordem").cast("string")),
                              title=F.concat_ws(" — ", "titulo", "titulo_secao"), text=text, url=F.col("secao_url"),
                              metadata=_meta("pagina_secao", "portal", secao="secao_slug", idioma="idioma", titulo_secao="titulo_secao", ancora="ancora"))
    return _tag("portal_pagina", cards, per)


def faq(t: Tables, table: str = "port_faq", source: str = "portal_faq") -> DataFrame:
    head = (F.concat(F.lit("FAQ da Computação-UFPel — "), F.coalesce("secao", F.lit("dúvidas gerais"))) if table == "port_faq"
            else T.join_lines(F.lit(f"FAQ de estudantes do {PROGRAMME}"), T.labelled("Contexto", "secao")))
    text = T.join_lines(head, T.labelled("Pergunta", "pergunta"), T.labelled("Resposta", "resposta"))
    rows = t[table]
    if table == "port_faq":
        rows = rows.join(t["port_pagina"].select("pagina_id", F.col("titulo").alias("pagina")), "pagina_id", "left")
        meta = _meta("faq", "portal", secao_faq="secao", pagina="pagina")
    else:
        meta = _meta("faq", "ppgc", secao_faq="secao")
    return _tag(source, chunk.portal_facets(rows, "faq_id", scope=F.lit("qa"), title=F.col("pergunta"), text=text, url=F.col("url"), metadata=meta))


def notices(t: Tables) -> DataFrame:
    line = F.concat(F.lit("  - "), F.coalesce(_named("tipo_documento", DOCUMENT_NAMES), F.lit("Documento")), F.lit(": "), F.coalesce("titulo", "url"))
    files = _full(t["ppgc_edital_documento"], "tipo_documento", "titulo", "url", "ordem")
    # The files are read once, for their number and their lines.
    row = F.struct(F.coalesce(F.col("ordem").cast("int"), F.lit(0)).alias("o"), line.alias("l"))
    listed = files.groupBy("edital_id").agg(F.count(F.lit(1)).alias("n_documentos"), F.collect_list(F.when(line.isNotNull(), row)).alias("lines"))
    lines = F.array_join(F.transform(F.array_sort("lines"), lambda s: s["l"]), "\n")
    docs = listed.select("edital_id", "n_documentos", F.when(F.size("lines") > 0, lines).alias("anexos"))
    e = _full(t["ppgc_edital"], "tipo", "nivel", "ano", "semestre", "periodo_letivo", "numero_oficial", "data_publicacao", "resumo", "texto", "url")
    e = e.join(docs, "edital_id", "left")
    meta = _meta("edital", "ppgc", edital_tipo="tipo", nivel="nivel", ano="ano", semestre="semestre", numero_oficial="numero_oficial",
                 n_documentos=F.coalesce("n_documentos", F.lit(0)))
    text = T.join_lines(
        F.lit(f"Edital do {PROGRAMME}"), T.labelled("Título", "titulo"), T.labelled("Tipo", _named("tipo", NOTICE_NAMES)), T.labelled("Nível", _named("nivel", LEVEL_NAMES)),
        T.labelled("Período letivo", "periodo_letivo"), T.labelled("Número oficial do edital", "numero_oficial"), T.labelled("Publicado em", "data_publicacao"),
        F.concat(F.lit("Documentos anexos:\n"), "anexos"), F.coalesce("texto", "resumo"))
    return _tag("ppgc_edital", chunk.portal_facets(e, "edital_id", scope=F.lit("edital"), title=F.col("titulo"), text=text, url=F.col("url"), metadata=meta))


def norms(t: Tables) -> DataFrame:
    state = (F.when(F.col("vigente"), "VIGENTE").when(~F.col("vigente"), "REVOGADA — não use como regra atual")
             .otherwise("situação não confirmada no índice de normas do Programa"))
    number = F.when(F.col("numero").isNotNull() & F.col("ano").isNotNull(), F.concat_ws("/", "numero", F.col("ano").cast("string"))).otherwise(F.col("ano").cast("string"))
    name = F.trim(F.concat_ws(" ", F.coalesce(_named("tipo", NORM_NAMES), F.lit("Norma")), number))
    text = T.join_lines(F.lit(f"Norma do {PROGRAMME}"), T.labelled("Identificação", name), T.labelled("Situação", state),
                        T.labelled("Ementa", F.coalesce("ementa", "titulo")), F.col("texto"))
    return _tag("ppgc_normativo", chunk.portal_facets(t["ppgc_normativo"], "normativo_id", scope=F.lit("norma"), title=name, text=text,
                                                      url=F.coalesce("url_pagina", "url_pdf"),
                                                      metadata=_meta("normativo", "ppgc", normativo_tipo="tipo", ano="ano", vigente="vigente")))


def programme_pages(t: Tables) -> DataFrame:
    """A card of each page with several sections, and one text per section, of pages that have no table of their own; a FAQ
    page has no card and keeps the sections whose title is not a question."""
    p = _full(t["ppgc_pagina"], "idioma", "data_modificacao", "resumo", "url").filter(~F.coalesce("categoria", F.lit("")).isin(*NORMALISED))
    many = t["ppgc_pagina_secao"].groupBy("pagina_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("pagina_id")
    card = T.join_lines(F.lit(f"Página do {PROGRAMME}"), T.labelled("Título", "titulo"), T.labelled("Assunto", "categoria"),
                        F.when(F.col("idioma") == "en", "Idioma: inglês"), T.labelled("Atualizada em", "data_modificacao"), F.col("resumo"))
    cards = chunk.portal_facets(
        p.filter(~F.col("categoria").eqNullSafe("faq")).join(many, "pagina_id"), "pagina_id", scope=F.lit("ficha"), title=F.col("titulo"), text=card,
        url=F.col("url"), metadata=_meta("pagina_ficha", "ppgc", categoria="categoria", idioma="idioma"))
    s = _full(t["ppgc_pagina_secao"], "ancora").join(p.select("pagina_id", "titulo", "categoria", "data_modificacao"), "pagina_id")
    s = s.filter(~(F.col("categoria").eqNullSafe("faq") & F.coalesce(F.trim("titulo_secao").endswith("?"), F.lit(False))))
    text = T.join_lines(F.lit(PROGRAMME), T.labelled("Página", "titulo"), T.labelled("Seção", "titulo_secao"), T.labelled("Assunto", "categoria"),
                        T.labelled("Atualizada em", "data_modificacao"), F.col("texto"))
    per = chunk.portal_facets(s, "pagina_id", scope=F.concat(F.lit("secao#"), F.col("ordem").cast("string")),
                              title=F.concat_ws(" — ", "titulo", "titulo_secao"), text=text, url=F.col("url"),
                              metadata=_meta("pagina_secao", "ppgc", categoria="categoria", titulo_secao="titulo_secao", ancora="ancora"))
    return _tag("ppgc_pagina", cards, per)


def programme_posts(t: Tables) -> DataFrame:
    tags = _distinct(t["ppgc_post_tag"], "post_id", F.col("tag_slug"), "tags")
    p = _full(t["ppgc_post"], "data_por_extenso", "assunto", "texto", "resumo", "ano", "mes", "data_publicacao", "url").join(tags, "post_id", "left")
    text = T.join_lines(F.lit(f"Notícia do {PROGRAMME}"), T.labelled("Título", "titulo"), T.labelled("Publicada em", "data_por_extenso"),
                        T.labelled("Assunto", _named("assunto", SUBJECT_NAMES)), T.labelled("Palavras-chave", F.array_join("tags", ", ")),
                        F.coalesce(F.nullif("texto", F.lit("")), "resumo"))
    meta = _meta("noticia", "ppgc", assunto="assunto", ano="ano", mes="mes", data="data_publicacao")
    return _tag("ppgc_noticia", chunk.portal_facets(p, "post_id", scope=F.lit("noticia"), title=F.col("titulo"), text=text, url=F.col("url"), metadata=meta))


def research_lines(t: Tables) -> DataFrame:
    text = T.join_lines(F.lit(f"Linha de pesquisa do {PROGRAMME}"), T.labelled("Linha", "nome"), F.col("descricao"))
    return _tag("ppgc_linha", chunk.portal_facets(
        _full(t["ppgc_linha_pesquisa"], "descricao", "url"), "slug", scope=F.lit("linha"), title=F.col("nome"), text=text, url=F.col("url"),
        metadata=_meta("linha_pesquisa", "ppgc", linha="nome")))


def programme_subjects(t: Tables) -> DataFrame:
    d = _full(t["ppgc_disciplina"], "creditos", "ano", "semestre", "responsavel", "aluno_especial", "horario", "modalidade", "ementa", "url")
    open_to = F.col("aluno_especial").cast("boolean")
    text = T.join_lines(
        F.lit(f"Disciplina do {PROGRAMME}"), T.labelled("Disciplina", "nome"), T.labelled("Créditos", "creditos"),
        T.labelled("Oferta", F.concat(F.col("ano").cast("string"), F.lit("/"), F.col("semestre").cast("string"))), T.labelled("Responsável", "responsavel"),
        T.labelled("Aberta a estudante especial", F.when(open_to, "sim").when(~open_to, "não")), T.labelled("Horário", "horario"),
        T.labelled("Modalidade", "modalidade"), T.labelled("Ementa", "ementa"))
    return _tag("ppgc_disciplina", chunk.portal_facets(
        d, "disciplina_id", scope=F.lit("disciplina"), title=F.col("nome"), text=text, url=F.col("url"),
        metadata=_meta("disciplina", "ppgc", ano="ano", semestre="semestre", aluno_especial="aluno_especial")))


def documents(t: Tables) -> DataFrame:
    """One facet per piece of a PDF, whole, headed by its document and the first notice that lists it."""
    from . import dedup
    first = dedup.keep_one(t["ppgc_edital_documento"].select("url", "edital_id", "ordem", "tipo_documento"), ["url"], [F.col("ordem"), F.col("edital_id")])
    notice = _full(t["ppgc_edital"], "periodo_letivo", "numero_oficial").select("edital_id", F.col("titulo").alias("edital"), "periodo_letivo", "numero_oficial")
    named = _full(t["ppgc_documento"], "titulo", "data_upload").select("url", "titulo", "data_upload")
    # Many pieces share a document: the notice is found per document, before the pieces meet it.
    known = named.join(first, "url", "left").join(notice, "edital_id", "left")
    c = _full(t["ppgc_documento_chunk"], "pagina_pdf").select("url", F.col("ordem").alias("piece"), "pagina_pdf", F.col("texto").alias("body")).join(known, "url")
    text = T.join_lines(
        F.lit(f"Documento do {PROGRAMME}"), T.labelled("Arquivo", "titulo"), T.labelled("Tipo", _named("tipo_documento", DOCUMENT_NAMES)), T.labelled("Edital", "edital"),
        T.labelled("Período letivo", "periodo_letivo"), T.labelled("Número oficial", "numero_oficial"), T.labelled("Página do PDF", "pagina_pdf"), F.col("body"))
    meta = _meta("documento_pdf", "ppgc", tipo_documento="tipo_documento", edital="edital", periodo_letivo="periodo_letivo", pagina_pdf="pagina_pdf",
                 data_upload="data_upload")
    return _tag("ppgc_documento", c.select(
        F.col("url").alias("key"), F.concat(F.lit("pdf#"), F.col("piece").cast("string")).alias("scope"), F.coalesce("titulo", "url").alias("title"), "url",
        text.alias("text"), F.lit(0).alias("chunk"), F.lit(1).alias("chunks"), meta.alias("metadata")))


BUILDERS = {"curso": courses, "disciplina": subjects, "servidor": staff, "projeto": projects, "turma": classes,
            "portal_noticia": portal_posts, "portal_pagina": portal_pages, "portal_faq": faq,
            "ppgc_edital": notices, "ppgc_normativo": norms, "ppgc_pagina": programme_pages,
            "ppgc_faq": lambda t: faq(t, "ppgc_faq", "ppgc_faq"), "ppgc_noticia": programme_posts,
            "ppgc_linha": research_lines, "ppgc_disciplina": programme_subjects, "ppgc_documento": documents}


def build(t: Tables, sources: list[str] | None = None) -> DataFrame:
    """Facets of the named sources (default: all whose tables exist).

    Columns: id, source, key (string), scope, title, url, text, chunk, chunks, metadata (map of texts).
    id is source, key and scope, which are unique together; with an embedding the rows are a corpus of vector search.
    """
    parts = []
    for name in sources or BUILDERS:
        try:
            part = BUILDERS[name](t)
        except KeyError:
            if sources:
                raise
            continue
        key = F.col("key").cast("string")
        parts.append(part.withColumns({"key": key, "id": F.concat_ws("/", "source", key, "scope")}))
    return reduce(DataFrame.unionByName, parts)


def current_version(versions: DataFrame) -> DataFrame:
    """Version of each course's matrix: the flagged one, else the highest number."""
    n = F.coalesce(T.to_int("versao"), F.lit(0))
    return versions.groupBy("curso_codigo").agg(F.max_by("versao", F.struct(
        F.when(F.col("is_atual"), 1).otherwise(0), n, "versao")).alias("versao"))
