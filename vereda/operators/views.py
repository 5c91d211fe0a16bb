"""The named views of the three relational schemas, over a mapping of tables.

Each function takes `t`, a mapping from table name to DataFrame, and returns the
view. `register` exposes them (and the tables) to SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dedup, relate

Tables = Mapping[str, DataFrame]


def vw_professor_computacao(t: Tables) -> DataFrame:
    sc = t["servidor_curso"].select("servidor_id", F.col("curso_codigo").alias("codigo_ufpel"))
    named = sc.join(t["curso"].select("codigo_ufpel", "nome"), "codigo_ufpel")
    area = t["servidor_area_atuacao"]
    staff = t["servidor"].select("servidor_id", "nome", "cargo", "titulacao", "lotacao_nome", "situacao",
                                 "vinculo_ativo", "data_saida_cargo", "email", "lattes_url", "curriculo_resumo", "url")
    return relate.distinct_arrays(staff, "servidor_id", {
        "cursos": (named, "nome"), "cursos_codigos": (named, "codigo_ufpel"),
        "areas_atuacao": (area, "area"), "areas_gerais": (area, "area_geral")})


def _section(t: Tables, slug: str, name: str) -> DataFrame:
    return (t["disciplina_conteudo"].filter(F.col("secao_slug") == slug)
            .select("disciplina_codigo", F.col("texto").alias(name)))


def vw_disciplina_curso(t: Tables) -> DataFrame:
    c = t["curso"].select(F.col("codigo_ufpel").alias("curso_codigo"), F.col("nome").alias("curso_nome"))
    v = t["curriculo_versao"].select("curso_codigo", "versao", F.col("is_atual").alias("versao_atual"))
    d = t["disciplina"].select(
        F.col("codigo").alias("disciplina_codigo"), F.col("nome").alias("disciplina_nome"),
        F.col("creditos").alias("d_creditos"), "carga_horaria", "unidade_nome", F.col("url").alias("disciplina_url"))
    m = t["curso_matriz"]
    j = (m.join(c, "curso_codigo").join(v, ["curso_codigo", "versao"]).join(d, "disciplina_codigo")
         .join(_section(t, "ementa", "ementa"), "disciplina_codigo", "left")
         .join(_section(t, "objetivos", "objetivos"), "disciplina_codigo", "left"))
    return j.select("curso_codigo", "curso_nome", "versao", "versao_atual", "bloco", "semestre_rotulo", "semestre_num",
                    "carater", "disciplina_codigo", "disciplina_nome", F.coalesce("creditos", "d_creditos").alias("creditos"),
                    F.coalesce("horas", "carga_horaria").alias("horas"), "unidade_nome", "disciplina_url", "ementa", "objetivos")


def _schedule(t: Tables) -> DataFrame:
    slot = F.concat_ws("", "dia_semana", F.lit(" "), F.substring("hora_inicio", 1, 5), F.lit("-"), F.substring("hora_fim", 1, 5))
    return t["turma_horario"].groupBy("turma_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ordem", slot.alias("s")))), lambda x: x["s"]), ", ").alias("horarios"))


def _class_base(t: Tables) -> DataFrame:
    d = t["disciplina"].select(F.col("codigo").alias("disciplina_codigo"), F.col("nome").alias("disciplina_nome"),
                               "creditos", "carga_horaria")
    return t["turma"].join(d, "disciplina_codigo").join(_schedule(t), "turma_id", "left")


def vw_turma_completa(t: Tables) -> DataFrame:
    """One row per class x course x version."""
    c = t["curso"].select(F.col("codigo_ufpel").alias("curso_codigo"), F.col("nome").alias("curso_nome"))
    bridge = t["turma_curriculo"].select("turma_id", "curso_codigo", "versao", "semestre_rotulo", "semestre_num").distinct()
    rows = relate.distinct_arrays(_class_base(t), "turma_id", {
        "professores": (t["turma_professor"], "nome"), "professores_ids": (t["turma_professor"], "servidor_id")})
    return (relate.left_many(rows, bridge, "turma_id").join(c, "curso_codigo", "left").select(
        "turma_id", "ano", "semestre", "codigo_turma", "vagas", "matriculados", "disciplina_codigo", "disciplina_nome",
        "curso_codigo", "curso_nome", "versao", "semestre_rotulo", "semestre_num", "professores", "professores_ids", "horarios"))


def vw_turma(t: Tables) -> DataFrame:
    """One row per class, bridges aggregated to arrays."""
    tc = t["turma_curriculo"]
    named = tc.join(t["curso"].select(F.col("codigo_ufpel").alias("curso_codigo"), F.col("nome").alias("curso_nome")), "curso_codigo")
    rows = relate.distinct_arrays(_class_base(t), "turma_id", {
        "cursos": (named, "curso_nome"), "cursos_codigos": (tc, "curso_codigo"), "versoes": (tc, "versao"),
        "semestres_rotulo": (tc, "semestre_rotulo"), "professores": (t["turma_professor"], "nome"),
        "professores_ids": (t["turma_professor"], "servidor_id")})
    first = tc.groupBy("turma_id").agg(F.min("semestre_num").alias("semestre_num"))
    return rows.join(first, "turma_id", "left").select(
        "turma_id", "ano", "semestre", "codigo_turma", "vagas", "matriculados", "disciplina_codigo", "disciplina_nome",
        "creditos", "carga_horaria", "cursos", "cursos_codigos", "versoes", "semestres_rotulo", "semestre_num",
        "professores", "professores_ids", "horarios")


def vw_projeto_professor(t: Tables) -> DataFrame:
    p = t["projeto"].select("projeto_id", "titulo", "enfase", "area_cnpq", "resumo", "coordenador_nome",
                            "unidade_origem", "data_inicio", "data_fim", "url")
    sp = t["servidor_projeto"].select("projeto_id", "servidor_id", "papel", "ch_semanal")
    s = t["servidor"].select("servidor_id", F.col("nome").alias("professor_nome"), F.col("lotacao_nome").alias("professor_lotacao"))
    return relate.left_many(p, sp, "projeto_id").join(s, "servidor_id", "left")


def vw_matriz_versao(t: Tables) -> DataFrame:
    c = t["curso"].select(F.col("codigo_ufpel").alias("curso_codigo"), F.col("nome").alias("curso_nome"))
    m = t["curso_matriz"].groupBy("curso_codigo", "versao").agg(
        F.count("disciplina_codigo").alias("n_disciplinas"),
        F.sum(F.coalesce("creditos", F.lit(0))).alias("creditos_totais"),
        F.sum(F.coalesce("horas", F.lit(0))).alias("horas_totais"),
        F.count_if(F.col("bloco") == "semestre").alias("n_obrigatorias"),
        F.count_if(F.col("bloco") == "optativas").alias("n_optativas"))
    j = t["curriculo_versao"].select("curso_codigo", "versao", "is_atual").join(c, "curso_codigo").join(
        m, ["curso_codigo", "versao"], "left")
    return j.na.fill(0, ["n_disciplinas", "creditos_totais", "horas_totais", "n_obrigatorias", "n_optativas"])


def _names(bridge: DataFrame, names: DataFrame, bridge_key: str, name_key: str, out: str) -> DataFrame:
    j = bridge.join(names.select(F.col(name_key).alias(bridge_key), F.col("nome").alias("__n")), bridge_key)
    return j.groupBy("post_id").agg(F.array_sort(F.collect_list("__n")).alias(out))


def vw_port_noticia(t: Tables) -> DataFrame:
    cats = _names(t["port_post_categoria"], t["port_categoria"], "categoria_id", "categoria_id", "categorias")
    tags = _names(t["port_post_tag"], t["port_tag"], "tag_id", "tag_id", "tags")
    author = t["port_autor"].select("autor_id", F.col("nome").alias("autor"))
    empty = F.array().cast("array<string>")
    return (t["port_post"].join(author, "autor_id", "left").join(cats, "post_id", "left").join(tags, "post_id", "left")
            .select("post_id", "titulo", "url", "data_publicacao", "data_por_extenso", "ano", "mes", "semestre",
                    "escopo_curso", "resumo", "n_palavras", "n_documentos", "autor",
                    F.coalesce("categorias", empty).alias("categorias"), F.coalesce("tags", empty).alias("tags")))


def vw_port_pagina(t: Tables) -> DataFrame:
    s = t["port_secao"].select("secao_slug", F.col("nome").alias("secao"))
    return t["port_pagina"].join(s, "secao_slug", "left").select(
        "pagina_id", "titulo", "url", "caminho", "nivel", "idioma", "data_modificacao", "n_palavras", "secao", "secao_slug", "resumo")


def vw_port_menu(t: Tables) -> DataFrame:
    paths = relate.tree_paths(t["port_menu_item"], item="item_id", parent="parent_item_id", title="titulo")
    return t["port_menu_item"].join(paths.select(F.col("item").alias("item_id"), F.col("path").alias("caminho_titulos")), "item_id")


def _page_title(t: Tables, name: str) -> DataFrame:
    return t["port_pagina"].select("pagina_id", F.col("titulo").alias(name))


def vw_port_calendario(t: Tables) -> DataFrame:
    return t["port_calendario_evento"].join(_page_title(t, "calendario"), "pagina_id").select(
        "evento_id", "data", "ano", "mes", "dia_semana", "descricao", "tipo", "url", "calendario")


def vw_port_faq(t: Tables) -> DataFrame:
    return t["port_faq"].join(_page_title(t, "pagina"), "pagina_id").select(
        "faq_id", "secao", "pergunta", "resposta", "url", "pagina")


def vw_port_documento(t: Tables) -> DataFrame:
    return t["port_documento"].select("url", "titulo", "extensao", "mime", "data_upload", "origem_tipo", "origem_titulo", "origem_url")


def vw_ppgc_edital(t: Tables) -> DataFrame:
    d = t["ppgc_edital_documento"].groupBy("edital_id").agg(
        F.count("*").cast("int").alias("n_documentos"),
        F.max(F.when(F.col("tipo_documento") == "edital", F.col("url"))).alias("url_edital_pdf"))
    return t["ppgc_edital"].join(d, "edital_id", "left").select(
        "edital_id", "titulo", "tipo", "nivel", "ano", "semestre", "periodo_letivo", "numero_oficial", "url",
        "data_publicacao", "resumo", F.coalesce("n_documentos", F.lit(0)).alias("n_documentos"), "url_edital_pdf")


def vw_ppgc_edital_mais_recente(t: Tables) -> DataFrame:
    e = t["ppgc_edital"].filter(F.col("ano").isNotNull()).select(
        "edital_id", "titulo", "tipo", "nivel", "ano", "semestre", "periodo_letivo", "numero_oficial", "url", "data_publicacao")
    never = F.lit("0001-01-01").cast("timestamp")
    published = F.coalesce(F.col("data_publicacao").cast("timestamp"), never)
    return dedup.keep_one(e, [F.col("tipo"), F.coalesce("nivel", F.lit("-"))],
                          [-F.col("ano"), -F.coalesce("semestre", F.lit(0)), -F.unix_seconds(published), F.col("edital_id")])


def vw_ppgc_edital_documento(t: Tables) -> DataFrame:
    e = t["ppgc_edital"].select("edital_id", F.col("titulo").alias("edital"), "tipo", "nivel", "ano", "semestre")
    d = t["ppgc_documento"].select("url", "extensao", "data_upload", F.col("texto_extraido").isNotNull().alias("texto_disponivel"))
    return t["ppgc_edital_documento"].join(e, "edital_id").join(d, "url").select(
        "edital_id", "edital", "tipo", "nivel", "ano", "semestre", "tipo_documento", F.col("titulo").alias("documento"),
        "secao", "url", "extensao", "data_upload", "texto_disponivel")


def vw_ppgc_normativo_vigente(t: Tables) -> DataFrame:
    return t["ppgc_normativo"].filter(F.coalesce("vigente", F.lit(False))).select(
        "normativo_id", "tipo", "numero", "ano", "titulo", "ementa", F.coalesce("url_pagina", "url_pdf").alias("url"),
        "url_pdf", F.col("texto").isNotNull().alias("tem_texto_integral"))


def vw_ppgc_agenda(t: Tables) -> DataFrame:
    return t["ppgc_calendario_evento"].filter(~F.col("situacao").eqNullSafe("cancelled")).select(
        "uid", "titulo", "descricao", "data_inicio", "data_fim", "hora_inicio", "dia_inteiro", "ano", "mes", "semestre",
        "data_por_extenso", "url_calendario").orderBy("data_inicio")


def vw_ppgc_requisito(t: Tables) -> DataFrame:
    return t["ppgc_requisito"].select("nivel", "obrigatorio", "requisito", "prazo", "url").orderBy(
        "nivel", F.col("obrigatorio").desc(), "requisito")


def vw_computacao_noticia(t: Tables) -> DataFrame | None:
    """Both news corpora with a source tag; None unless both are loaded."""
    if "port_post" not in t or "ppgc_post" not in t:
        return None
    cols = ["post_id", "titulo", "url", "data_publicacao", "data_por_extenso", "ano", "mes", "resumo"]
    return (t["port_post"].select(F.lit("portal").alias("acervo"), *cols)
            .unionByName(t["ppgc_post"].select(F.lit("ppgc").alias("acervo"), *cols)))


def pdf_chunk_context(t: Tables) -> DataFrame:
    """PDF pieces with their document and the first notice that lists it."""
    first = dedup.keep_one(t["ppgc_edital_documento"].select("url", "edital_id", "ordem", "tipo_documento"),
                           ["url"], [F.col("ordem"), F.col("edital_id")])
    e = t["ppgc_edital"].select("edital_id", F.col("titulo").alias("edital_titulo"))
    return (t["ppgc_documento_chunk"].withColumnRenamed("documento_url", "url")
            .join(t["ppgc_documento"].select("url", F.col("titulo").alias("documento_titulo")), "url")
            .join(first.select("url", "edital_id", "tipo_documento"), "url", "left").join(e, "edital_id", "left"))


def docente_servidor(t: Tables) -> DataFrame:
    """Programme teachers matched to the institutional staff table."""
    return t["ppgc_docente"].join(t["servidor"].withColumnRenamed("nome", "servidor_nome"), "servidor_id")


VIEWS: dict[str, Callable[[Tables], DataFrame | None]] = {
    f.__name__: f for f in (
        vw_professor_computacao, vw_disciplina_curso, vw_turma_completa, vw_turma, vw_projeto_professor, vw_matriz_versao,
        vw_port_noticia, vw_port_pagina, vw_port_menu, vw_port_calendario, vw_port_faq, vw_port_documento,
        vw_ppgc_edital, vw_ppgc_edital_mais_recente, vw_ppgc_edital_documento, vw_ppgc_normativo_vigente,
        vw_ppgc_agenda, vw_ppgc_requisito, vw_computacao_noticia)}


def register(tables: Tables) -> list[str]:
    """Create temp views for the tables and for every view whose inputs exist."""
    made = []
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    for name, build in VIEWS.items():
        try:
            view = build(tables)
        except KeyError:
            continue
        if view is not None:
            view.createOrReplaceTempView(name)
            made.append(name)
    return made
