"""Facets with metadata of entities that are derived from the given tables, compared whole, and the search over them.

supplier stands for staff, nation for courses and projects, part for subjects and norms, orders and lineitem for notices and
their files, documents for pieces of PDFs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets as E
from ..operators import nearest
from . import retrieval, tools, viewed
from .registry import query

#: Derived table -> (given table, its columns), beside those of the views.
ENTITIES = viewed.ENTITIES | {
    "servidor": ("supplier", "s_suppkey AS servidor_id, s_name AS nome, CASE WHEN s_suppkey % 5 > 0 THEN 'Professor' END AS cargo, 'Doutorado' AS titulacao, "
                 "concat('U', s_nationkey) AS lotacao_nome, CASE WHEN s_suppkey % 3 = 0 THEN '40 horas' END AS regime_jornada, "
                 "CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 4 = 1 END AS vinculo_ativo, CASE WHEN s_suppkey % 4 = 2 THEN DATE '2020-02-01' END AS data_saida_cargo, "
                 "CASE WHEN s_suppkey % 2 = 0 THEN concat('Resumo do currículo de ', s_name) ELSE 'breve' END AS curriculo_resumo, concat('/s/', s_suppkey) AS url"),
    "servidor_area_atuacao": ("customer", "c_custkey % 1000 AS servidor_id, concat('Área ', c_mktsegment) AS area, c_custkey AS ordem"),
    "servidor_formacao": ("supplier", "s_suppkey AS servidor_id, 1 AS ordem, concat('Doutorado em Computação por U', s_nationkey) AS texto_original"),
    "servidor_projeto": ("supplier", "s_nationkey AS projeto_id, s_suppkey AS servidor_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Membro' END AS papel"),
    "projeto": ("nation", "n_nationkey AS projeto_id, n_name AS titulo, CASE WHEN n_nationkey % 2 = 0 THEN 'Pesquisa' END AS enfase, 'Computação' AS area_cnpq, "
                "CASE WHEN n_regionkey > 0 THEN 'resumo' END AS resumo, concat('C', n_regionkey) AS coordenador_nome, 'CDTec' AS unidade_origem, "
                "CASE WHEN n_regionkey > 1 THEN DATE '2021-03-04' END AS data_inicio, CAST(NULL AS DATE) AS data_fim, concat('/p/', n_nationkey) AS url"),
    "projeto_info_secao": ("nation", "n_nationkey AS projeto_id, 'Objetivo Geral' AS secao, 'objetivo_geral' AS secao_slug, concat('Estudar o que liga ', n_name, ' ao mundo') AS texto"),
    "disciplina_conteudo": ("part", "CAST(p_partkey AS VARCHAR(20)) AS disciplina_codigo, 'Ementa' AS secao, CASE WHEN p_partkey % 2 = 0 THEN 'ementa' ELSE 'objetivos' END AS secao_slug, "
                            "concat('Conteúdo sobre ', p_type, ' e ', p_name) AS texto"),
    "ppgc_edital": ("orders", "o_orderkey AS edital_id, concat('Edital ', o_orderkey) AS titulo, CASE WHEN o_custkey % 3 = 0 THEN 'dinter' WHEN o_custkey % 3 = 1 THEN 'resultado' ELSE 'x' END AS tipo, "
                    "CASE WHEN o_orderstatus <> 'P' THEN 'ambos' END AS nivel, year(o_orderdate) AS ano, CASE WHEN o_custkey % 2 = 0 THEN 1 END AS semestre, "
                    "concat(year(o_orderdate), '/1') AS periodo_letivo, CASE WHEN o_custkey % 5 = 0 THEN 'n7' END AS numero_oficial, concat('/e/', o_orderkey) AS url, "
                    "CASE WHEN o_custkey % 4 > 0 THEN CAST(o_orderdate AS DATE) END AS data_publicacao, concat('Resumo do edital ', o_orderkey) AS resumo"),
    "ppgc_documento": ("documents", "DISTINCT concat('/doc/', source) AS url, concat('Arquivo ', source) AS titulo"),
    "ppgc_documento_chunk": ("documents", "concat('/doc/', source) AS url, doc_id AS ordem, doc_id % 7 AS pagina_pdf, text AS texto"),
    "notice_file": ("nation", "n_nationkey AS edital_id, concat('/doc/src', n_nationkey % 12) AS url, CASE WHEN n_regionkey > 2 THEN 'resultado' ELSE 'y' END AS tipo_documento, n_nationkey AS ordem"),
}


def _ctes(uses: str) -> str:
    return ", ".join(f"{u} AS (SELECT {ENTITIES[u][1]} FROM {ENTITIES[u][0]})" for u in uses.split())


def _tables(t, **other):
    lazy = viewed._Lazy(t, ENTITIES)
    lazy.update({name: lazy[of] for name, of in other.items()})
    return lazy


def facet(source: str, uses: str, metadata: str, sql: str, **other):
    """Registers the facets of a source; each named metadata value is a column m_name."""
    columns = ["key", "scope", "title", "url", "text", "chunk", "chunks", *[f"metadata['{m}'] AS m_{m}" for m in metadata.split()]]
    query(f"facet_{source}", f"WITH {_ctes(uses)}, {sql}")(lambda t: E.build(_tables(t, **other), [source]).selectExpr(*columns))


STAFF_SQL = """
c AS (SELECT servidor_id, list_sort(list(DISTINCT curso.nome)) AS cursos FROM servidor_curso JOIN curso ON curso_codigo = codigo_ufpel GROUP BY 1),
a AS (SELECT servidor_id, list(area ORDER BY ordem) AS areas FROM servidor_area_atuacao GROUP BY 1),
p AS (SELECT servidor_id, count(*) AS n, string_agg('  - ' || titulo || ' (' || coalesce(enfase, 'ênfase não informada') || coalesce(', ' || lower(papel), '') || ')', chr(10) ORDER BY titulo) AS projetos
 FROM servidor_projeto JOIN projeto USING (projeto_id) GROUP BY 1),
s AS (SELECT *, 'Professor(a) ' || nome AS label FROM servidor LEFT JOIN c USING (servidor_id) LEFT JOIN a USING (servidor_id) LEFT JOIN p USING (servidor_id)
 LEFT JOIN servidor_formacao USING (servidor_id)),
f AS (SELECT *, 'ficha' AS scope, label AS title, concat_ws(chr(10), 'Cargo: ' || coalesce(cargo, 'não informado') || ' | Titulação: ' || titulacao, 'Lotação: ' || lotacao_nome,
  'Regime: ' || regime_jornada, CASE WHEN NOT vinculo_ativo THEN coalesce('Vínculo NÃO corrente: encerrado em ' || data_saida_cargo || '.', 'Vínculo NÃO corrente na UFPel.') END,
  'Professor(a) dos cursos de Computação: ' || array_to_string(cursos, ', '), 'Áreas de atuação: ' || array_to_string(areas, '; ')) AS body, NULL AS led FROM s
 UNION ALL SELECT *, 'curriculo_resumo', label || ' — Resumo do currículo', curriculo_resumo, NULL FROM s
 UNION ALL SELECT *, 'areas_atuacao', label || ' — Áreas de atuação e pesquisa', '  - ' || array_to_string(areas, chr(10) || '  - '), NULL FROM s
 UNION ALL SELECT *, 'formacao', label || ' — Formação acadêmica', '  - ' || texto_original, NULL FROM s
 UNION ALL SELECT *, 'projetos', label || ' — Projetos vigentes', projetos, n::VARCHAR FROM s)"""
facet("servidor", "servidor servidor_curso curso servidor_area_atuacao servidor_formacao servidor_projeto projeto",
      "tipo servidor_id cursos lotacao titulacao areas vinculo_ativo n_projetos chunk", f"""{STAFF_SQL}
SELECT servidor_id::VARCHAR AS key, scope, title, url, title || chr(10) || trim(body, chr(10) || ' ') AS text, 1 AS chunk, 1 AS chunks, 'servidor' AS m_tipo, servidor_id::VARCHAR AS m_servidor_id,
 to_json(coalesce(cursos, []))::VARCHAR AS m_cursos, lotacao_nome AS m_lotacao, titulacao AS m_titulacao, to_json(coalesce(areas, []))::VARCHAR AS m_areas,
 coalesce(vinculo_ativo, true)::VARCHAR AS m_vinculo_ativo, led AS m_n_projetos, '1' AS m_chunk FROM f WHERE length(trim(body, chr(10) || ' ')) >= 25""")
facet("projeto", "servidor servidor_projeto projeto projeto_info_secao", "tipo projeto_id enfase area_cnpq unidade professores secao", """
e AS (SELECT projeto_id, list_sort(list(DISTINCT nome)) AS equipe FROM servidor_projeto JOIN servidor USING (servidor_id) GROUP BY 1),
p AS (SELECT *, 'Projeto ' || titulo AS label FROM projeto LEFT JOIN e USING (projeto_id)),
f AS (SELECT p.*, 'ficha' AS scope, label AS title, concat_ws(chr(10), 'Ênfase: ' || coalesce(enfase, 'não informado') || ' | Área CNPq: ' || area_cnpq, 'Coordenador: ' || coordenador_nome,
  'Unidade de origem: ' || unidade_origem, 'Vigência: ' || coalesce(data_inicio::VARCHAR, '?') || ' a sem data final', 'Professores envolvidos: ' || array_to_string(equipe, ', '),
  'Resumo: ' || resumo) AS body, NULL AS secao FROM p
 UNION ALL SELECT p.*, secao_slug, label || ' — ' || secao, texto, secao FROM p JOIN projeto_info_secao USING (projeto_id))
SELECT projeto_id::VARCHAR AS key, scope, title, url, title || chr(10) || body AS text, 1 AS chunk, 1 AS chunks, 'projeto' AS m_tipo, projeto_id::VARCHAR AS m_projeto_id, enfase AS m_enfase,
 area_cnpq AS m_area_cnpq, unidade_origem AS m_unidade, to_json(coalesce(equipe, []))::VARCHAR AS m_professores, secao AS m_secao FROM f""")
facet("disciplina", "disciplina curso curso_matriz disciplina_conteudo", "tipo disciplina_codigo cursos unidade creditos secao", """
o AS (SELECT disciplina_codigo AS codigo, list_sort(list(DISTINCT c.nome)) AS cursos, array_to_string(list_sort(list(DISTINCT c.nome || ' (' || semestre_rotulo || ', ' || carater || ')')), '; ') AS oferta
 FROM curso_matriz JOIN curso c ON curso_codigo = codigo_ufpel GROUP BY 1),
d AS (SELECT x.*, cursos, oferta, 'Disciplina ' || nome || ' (código ' || codigo || ')' AS label FROM disciplina x LEFT JOIN o USING (codigo)),
f AS (SELECT d.*, 'ficha' AS scope, label AS title, concat_ws(chr(10), 'Créditos: ' || creditos || ' | Carga horária: ' || carga_horaria || ' horas', 'Tipo: não informado | Periodicidade: não informado',
  'Unidade responsável: ' || unidade_nome, 'Ofertada em: ' || oferta, 'Ementa: ' || texto) AS body, NULL AS secao FROM d
  LEFT JOIN disciplina_conteudo s ON s.disciplina_codigo = codigo AND secao_slug = 'ementa'
 UNION ALL SELECT d.*, secao_slug, label || ' — ' || secao, texto, secao FROM d JOIN disciplina_conteudo s ON s.disciplina_codigo = codigo)
SELECT codigo AS key, scope, title, url, title || chr(10) || body AS text, 1 AS chunk, 1 AS chunks, 'disciplina' AS m_tipo, codigo AS m_disciplina_codigo,
 to_json(coalesce(cursos, []))::VARCHAR AS m_cursos, unidade_nome AS m_unidade, creditos::VARCHAR AS m_creditos, secao AS m_secao FROM f""")
facet("ppgc_edital", "ppgc_edital ppgc_edital_documento", "tipo acervo edital_tipo nivel ano semestre numero_oficial n_documentos chunk", """
d AS (SELECT edital_id, count(*) AS n, string_agg('  - ' || CASE tipo_documento WHEN 'edital' THEN 'Edital' ELSE 'Documento' END || ': ' || titulo, chr(10) ORDER BY ordem,
  '  - ' || CASE tipo_documento WHEN 'edital' THEN 'Edital' ELSE 'Documento' END || ': ' || titulo) AS anexos FROM ppgc_edital_documento GROUP BY 1)
SELECT edital_id::VARCHAR AS key, 'edital' AS scope, titulo AS title, url, concat_ws(chr(10), 'Edital do PPGC — Programa de Pós-Graduação em Computação da UFPel', 'Título: ' || titulo,
 'Tipo: ' || CASE tipo WHEN 'dinter' THEN 'doutorado interinstitucional (DInter)' WHEN 'resultado' THEN 'resultado / homologação de processo seletivo' END,
 CASE WHEN nivel IS NOT NULL THEN 'Nível: Mestrado e Doutorado' END, 'Período letivo: ' || periodo_letivo, 'Número oficial do edital: ' || numero_oficial, 'Publicado em: ' || data_publicacao,
 'Documentos anexos:' || chr(10) || anexos, resumo) AS text, 0 AS chunk, 1 AS chunks, 'edital' AS m_tipo, 'ppgc' AS m_acervo, tipo AS m_edital_tipo, nivel AS m_nivel, ano::VARCHAR AS m_ano,
 semestre::VARCHAR AS m_semestre, numero_oficial AS m_numero_oficial, coalesce(n, 0)::VARCHAR AS m_n_documentos, NULL::VARCHAR AS m_chunk FROM ppgc_edital LEFT JOIN d USING (edital_id)""")

PIECES_SQL = """
g AS (SELECT url, arg_min(edital_id, ordem) AS edital_id, arg_min(tipo_documento, ordem) AS tipo_documento FROM notice_file GROUP BY 1),
k AS (SELECT d.url, d.titulo, tipo_documento, e.titulo AS edital, periodo_letivo, numero_oficial FROM ppgc_documento d LEFT JOIN g USING (url) LEFT JOIN ppgc_edital e USING (edital_id))"""
facet("ppgc_documento", "ppgc_documento ppgc_documento_chunk ppgc_edital notice_file", "tipo acervo tipo_documento edital periodo_letivo pagina_pdf data_upload", f"""{PIECES_SQL}
SELECT url AS key, 'pdf#' || ordem AS scope, titulo AS title, url, concat_ws(chr(10), 'Documento do PPGC — Programa de Pós-Graduação em Computação da UFPel', 'Arquivo: ' || titulo,
 CASE WHEN tipo_documento = 'resultado' THEN 'Tipo: Resultado' END, 'Edital: ' || edital, 'Período letivo: ' || periodo_letivo, 'Número oficial: ' || numero_oficial,
 'Página do PDF: ' || pagina_pdf, nullif(texto, '')) AS text, 0 AS chunk, 1 AS chunks, 'documento_pdf' AS m_tipo, 'ppgc' AS m_acervo, tipo_documento AS m_tipo_documento, edital AS m_edital,
 periodo_letivo AS m_periodo_letivo, pagina_pdf::VARCHAR AS m_pagina_pdf, NULL::VARCHAR AS m_data_upload FROM ppgc_documento_chunk JOIN k USING (url)""",
      ppgc_edital_documento="notice_file")


@query("facet_semantic_search", f"""
WITH dims AS (SELECT label, i, round(avg(embedding[i]::DOUBLE), 6) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
proto AS (SELECT label AS query_id, list(m ORDER BY i) AS q FROM dims GROUP BY label),
{_ctes("servidor servidor_curso curso servidor_area_atuacao servidor_formacao servidor_projeto projeto ppgc_documento ppgc_documento_chunk ppgc_edital notice_file")},
{STAFF_SQL}, {PIECES_SQL},
rows AS (SELECT 'servidor' AS source, servidor_id::VARCHAR AS key, scope, title, servidor_id AS v, title || chr(10) || body AS text, 'servidor' AS tipo, NULL AS acervo,
  coalesce(vinculo_ativo, true)::VARCHAR AS vinculo_ativo FROM f WHERE length(trim(body, chr(10) || ' ')) >= 25
 UNION ALL SELECT 'ppgc_documento', url, 'pdf#' || ordem, titulo, ordem, NULL, 'documento_pdf', 'ppgc', NULL FROM ppgc_documento_chunk JOIN k USING (url)),
pairs AS (SELECT query_id, source || '/' || key || '/' || scope AS id, rows.* EXCLUDE (v, text), round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q), 4) + 0.0 AS score
 FROM rows JOIN embeddings ON vec_id = v, proto),
branch AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS b FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM branch WHERE b <= 6)
SELECT query_id, id, score, rank, source, key, scope, title, tipo, acervo, vinculo_ativo, CASE WHEN source = 'servidor' THEN 3 ELSE 2 END AS shown FROM ranked WHERE rank <= 6""")
def facet_semantic_search(t):
    """The semantic tool over facets of two sources, each with the given vector of its person or piece."""
    built = E.build(_tables(t, ppgc_edital_documento="notice_file"), ["servidor", "ppgc_documento"])
    place = F.when(F.col("source") == "servidor", F.col("key")).otherwise(F.substring_index("scope", "#", -1)).cast("long")
    corpus = built.withColumn("vec_id", place).join(t.embeddings.select("vec_id", "embedding"), "vec_id")
    asked = nearest.prototypes(t.embeddings, "label").withColumnRenamed("label", "query_id")
    meta = F.col("metadata")
    return tools.semantic_search(corpus, asked).select(
        "query_id", "id", "score", "rank", "source", "key", "scope", "title", meta["tipo"].alias("tipo"), meta["acervo"].alias("acervo"),
        meta["vinculo_ativo"].alias("vinculo_ativo"), F.size(meta).alias("shown"))


FOUND_SQL = """(SELECT 'curso' AS entity, codigo_ufpel AS key, nome AS txt, NULL AS url FROM curso UNION ALL SELECT 'disciplina', codigo, nome, url FROM disciplina
 UNION ALL SELECT 'servidor', servidor_id::VARCHAR, nome, url FROM servidor UNION ALL SELECT 'projeto', projeto_id::VARCHAR, titulo, url FROM projeto)"""


@query("tool_find_names", f"""
WITH {_ctes("curso disciplina servidor projeto")}, cat AS {FOUND_SQL}, q AS {retrieval._tri_sql(retrieval.WORDS_SQL)}, n AS {retrieval._tri_sql(FOUND_SQL)},
pairs AS (SELECT q.txt AS question, n.txt AS name, {retrieval.SIM_SQL} AS sim FROM q, n
 WHERE {retrieval.SIM_SQL} > 0.15 OR contains(strip_accents(lower(n.txt)), strip_accents(lower(q.txt)))),
ranked AS (SELECT question, entity, key, name, url, sim, row_number() OVER (PARTITION BY question ORDER BY sim DESC, entity, name, key) AS rank FROM pairs JOIN cat ON txt = name)
SELECT * FROM ranked WHERE rank <= 6""")
def tool_find_names(t):
    """The institutional entities whose names are like each word of a part's name."""
    asked = t.part.select(F.explode(F.split("p_name", " ")).alias("text")).distinct()
    return tools.find_names(_tables(t), asked, "institucional")
