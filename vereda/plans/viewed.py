"""The named views over entities that are derived from the given tables.

nation stands for courses, part for subjects, supplier for staff, customer for authors, orders for projects, posts, pages
and notices, lineitem for the bridges between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import views as V
from .registry import query

#: Derived table -> (given table, its columns as SQL that Spark and DuckDB read alike).
ENTITIES = {
    "curso": ("nation", "CAST(n_nationkey AS VARCHAR(20)) AS codigo_ufpel, n_name AS nome"),
    "disciplina": ("part", "CAST(p_partkey AS VARCHAR(20)) AS codigo, p_name AS nome, p_size AS creditos, p_size * 15 AS carga_horaria, "
                   "p_brand AS unidade_nome, concat('/d/', p_partkey) AS url"),
    "curriculo_versao": ("nation", "CAST(n_nationkey AS VARCHAR(20)) AS curso_codigo, '1' AS versao, n_nationkey % 2 = 0 AS is_atual"),
    "curso_matriz": ("part", "CAST(p_partkey % 20 AS VARCHAR(20)) AS curso_codigo, '1' AS versao, CAST(p_partkey AS VARCHAR(20)) AS disciplina_codigo, "
                     "CASE WHEN p_partkey % 3 = 0 THEN 'semestre' ELSE 'optativas' END AS bloco, concat(p_size % 8 + 1, 'o') AS semestre_rotulo, "
                     "p_size % 8 + 1 AS semestre_num, 'Obr' AS carater, CASE WHEN p_partkey % 4 > 0 THEN p_size + 1 END AS creditos, "
                     "CASE WHEN p_partkey % 5 > 0 THEN p_size * 17 END AS horas"),
    "disciplina_conteudo": ("part", "CAST(p_partkey AS VARCHAR(20)) AS disciplina_codigo, CASE WHEN p_partkey % 2 = 0 THEN 'ementa' ELSE 'objetivos' END AS secao_slug, p_type AS texto"),
    "servidor": ("supplier", "s_suppkey AS servidor_id, s_name AS nome, 'Professor' AS cargo, 'Doutorado' AS titulacao, concat('U', s_nationkey) AS lotacao_nome, "
                 "'Ativo' AS situacao, s_suppkey % 2 = 0 AS vinculo_ativo, CAST(NULL AS DATE) AS data_saida_cargo, concat(s_suppkey, '@x') AS email, "
                 "'l' AS lattes_url, 'r' AS curriculo_resumo, concat('/s/', s_suppkey) AS url"),
    "servidor_curso": ("supplier", "s_suppkey AS servidor_id, CAST(s_nationkey AS VARCHAR(20)) AS curso_codigo"),
    "servidor_area_atuacao": ("supplier", "s_suppkey AS servidor_id, concat('A', s_suppkey % 7) AS area, concat('G', s_suppkey % 3) AS area_geral"),
    "projeto": ("orders", "o_orderkey AS projeto_id, concat('Projeto ', o_orderkey) AS titulo, o_orderpriority AS enfase, 'x' AS area_cnpq, o_orderstatus AS resumo, "
                "concat('C', o_custkey) AS coordenador_nome, 'u' AS unidade_origem, CAST(o_orderdate AS DATE) AS data_inicio, CAST(NULL AS DATE) AS data_fim, concat('/p/', o_orderkey) AS url"),
    "servidor_projeto": ("lineitem", "DISTINCT l_orderkey AS projeto_id, l_suppkey AS servidor_id, 'membro' AS papel, 4 AS ch_semanal"),
    "port_post": ("orders", "o_orderkey AS post_id, concat('Post ', o_orderkey) AS titulo, concat('/n/', o_orderkey) AS url, CAST(o_orderdate AS DATE) AS data_publicacao, "
                  "'d' AS data_por_extenso, year(o_orderdate) AS ano, month(o_orderdate) AS mes, 1 AS semestre, 'cc' AS escopo_curso, o_orderpriority AS resumo, "
                  "10 AS n_palavras, 0 AS n_documentos, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS autor_id"),
    "port_autor": ("customer", "c_custkey AS autor_id, c_name AS nome"),
    "port_categoria": ("region", "r_regionkey AS categoria_id, r_name AS nome"),
    "port_post_categoria": ("lineitem", "DISTINCT l_orderkey AS post_id, l_linenumber % 5 AS categoria_id"),
    "port_tag": ("nation", "n_nationkey AS tag_id, n_name AS nome"),
    "port_post_tag": ("lineitem", "DISTINCT l_orderkey AS post_id, l_suppkey % 25 AS tag_id"),
    "port_secao": ("region", "concat('s', r_regionkey) AS secao_slug, r_name AS nome"),
    "port_pagina": ("orders", "o_orderkey AS pagina_id, concat('Página ', o_orderkey) AS titulo, concat('/g/', o_orderkey) AS url, 'c' AS caminho, 1 AS nivel, 'pt' AS idioma, "
                    "CAST(o_orderdate AS DATE) AS data_modificacao, 5 AS n_palavras, concat('s', o_custkey % 7) AS secao_slug, o_orderstatus AS resumo"),
    "port_calendario_evento": ("customer", "c_custkey AS evento_id, DATE '2026-01-01' AS data, 2026 AS ano, 1 AS mes, 'Qui' AS dia_semana, c_name AS descricao, 'Feriados' AS tipo, "
                               "'u' AS url, c_custkey * 2 AS pagina_id"),
    "port_faq": ("customer", "c_custkey AS faq_id, c_mktsegment AS secao, concat(c_name, '?') AS pergunta, 'Sim' AS resposta, 'u' AS url, c_custkey * 3 AS pagina_id"),
    "ppgc_edital": ("orders", "o_orderkey AS edital_id, concat('Edital ', o_orderkey) AS titulo, o_orderpriority AS tipo, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS nivel, "
                    "CASE WHEN o_custkey % 9 > 0 THEN year(o_orderdate) END AS ano, CASE WHEN o_custkey % 2 = 0 THEN 1 END AS semestre, '1' AS periodo_letivo, 'n' AS numero_oficial, "
                    "concat('/e/', o_orderkey) AS url, CASE WHEN o_custkey % 4 > 0 THEN CAST(o_orderdate AS DATE) END AS data_publicacao, 'r' AS resumo"),
    "ppgc_edital_documento": ("lineitem", "l_orderkey AS edital_id, concat('/doc/', l_partkey) AS url, CASE WHEN l_linenumber = 1 THEN 'edital' ELSE 'errata' END AS tipo_documento, "
                              "concat('Doc ', l_linenumber) AS titulo, 's' AS secao, l_linenumber AS ordem"),
    "ppgc_documento": ("part", "concat('/doc/', p_partkey) AS url, p_name AS titulo, 'pdf' AS extensao, DATE '2026-01-02' AS data_upload, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS texto_extraido"),
    "ppgc_normativo": ("part", "p_partkey AS normativo_id, p_brand AS tipo, p_size AS numero, 2020 AS ano, p_name AS titulo, p_type AS ementa, "
                       "CASE WHEN p_partkey % 3 = 0 THEN concat('/pg/', p_partkey) END AS url_pagina, concat('/pdf/', p_partkey) AS url_pdf, "
                       "CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 2 = 0 END AS vigente, CASE WHEN p_partkey % 5 = 0 THEN p_name END AS texto"),
    "turma": ("orders", "o_orderkey AS turma_id, year(o_orderdate) AS ano, 1 AS semestre, o_orderstatus AS codigo_turma, 40 AS vagas, o_custkey % 40 AS matriculados, "
              "CAST(o_custkey AS VARCHAR(20)) AS disciplina_codigo"),
    "turma_professor": ("lineitem", "l_orderkey AS turma_id, CASE WHEN l_linenumber < 7 THEN l_suppkey END AS servidor_id, concat('P', l_suppkey) AS nome"),
    "turma_horario": ("lineitem", "DISTINCT l_orderkey AS turma_id, l_linenumber AS ordem, CASE WHEN l_linenumber % 2 = 0 THEN 'SEG' ELSE 'QUA' END AS dia_semana, "
                      "'08:00:00' AS hora_inicio, '09:40:00' AS hora_fim"),
    "turma_curriculo": ("lineitem", "l_orderkey AS turma_id, CAST(l_suppkey % 30 AS VARCHAR(20)) AS curso_codigo, CAST(l_linenumber % 3 AS VARCHAR(20)) AS versao, "
                        "concat(l_linenumber % 2, 'o') AS semestre_rotulo, l_linenumber AS semestre_num"),
    "port_documento": ("part", "concat('/doc/', p_partkey) AS url, p_name AS titulo, 'pdf' AS extensao, 'application/pdf' AS mime, DATE '2026-01-02' AS data_upload, "
                       "p_type AS origem_tipo, p_brand AS origem_titulo, concat('/g/', p_size) AS origem_url"),
    "ppgc_calendario_evento": ("orders", "CAST(o_orderkey AS VARCHAR(20)) AS uid, concat('Evento ', o_orderkey) AS titulo, o_orderpriority AS descricao, CAST(o_orderdate AS DATE) AS data_inicio, "
                               "CAST(NULL AS DATE) AS data_fim, '08:00' AS hora_inicio, o_custkey % 2 = 0 AS dia_inteiro, year(o_orderdate) AS ano, month(o_orderdate) AS mes, 1 AS semestre, "
                               "'d' AS data_por_extenso, 'u' AS url_calendario, CASE WHEN o_orderstatus = 'F' THEN 'cancelled' WHEN o_orderstatus = 'O' THEN 'confirmed' END AS situacao"),
    "ppgc_requisito": ("part", "p_brand AS nivel, p_size % 2 = 0 AS obrigatorio, p_name AS requisito, CASE WHEN p_size > 9 THEN p_type END AS prazo, concat('/r/', p_partkey) AS url"),
    "ppgc_documento_chunk": ("part", "concat('/doc/', p_partkey) AS documento_url, p_size AS ordem, p_type AS texto"),
    "ppgc_docente": ("supplier", "s_suppkey AS docente_id, concat('D', s_suppkey) AS nome, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS servidor_id"),
}


class _Lazy(dict):
    """Derived tables, built when a view asks for them."""

    def __init__(self, t, entities: dict[str, tuple[str, str]] = ENTITIES):
        super().__init__()
        self.t, self.entities = t, entities

    def __missing__(self, name: str) -> DataFrame:
        table, columns = self.entities[name]
        distinct, columns = columns.startswith("DISTINCT "), columns.removeprefix("DISTINCT ")
        view = getattr(self.t, table).selectExpr(*_listed(columns))
        self[name] = view.distinct() if distinct else view
        return self[name]


def _listed(columns: str) -> list[str]:
    """The columns of a select list, split at commas outside brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for c in columns:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return [c.strip() for c in out]


def view(name: str, uses: str, sql: str, select: str = "*"):
    """Registers a view of the view module; `uses` are the derived tables that the SQL reads."""
    ctes = ", ".join(f"{u} AS (SELECT {ENTITIES[u][1]} FROM {ENTITIES[u][0]})" for u in uses.split())
    build = getattr(V, name)

    def run(t):
        out = build(_Lazy(t))
        return out if select == "*" else out.select(*[c.strip() for c in select.split(",")])

    query(name if name.startswith("vw_") else f"view_{name}", f"WITH {ctes} {sql}")(run)


view("vw_professor_computacao", "servidor servidor_curso curso servidor_area_atuacao", """
SELECT servidor_id, nome, lotacao_nome, vinculo_ativo,
 coalesce((SELECT list_sort(list(DISTINCT c.nome)) FROM servidor_curso x JOIN curso c ON c.codigo_ufpel = x.curso_codigo WHERE x.servidor_id = s.servidor_id), []) AS cursos,
 coalesce((SELECT list_sort(list(DISTINCT a.area)) FROM servidor_area_atuacao a WHERE a.servidor_id = s.servidor_id), []) AS areas_atuacao FROM servidor s""",
     "servidor_id, nome, lotacao_nome, vinculo_ativo, cursos, areas_atuacao")
view("vw_disciplina_curso", "curso curriculo_versao disciplina curso_matriz disciplina_conteudo", """
SELECT m.curso_codigo, c.nome AS curso_nome, m.versao, v.is_atual AS versao_atual, m.bloco, m.semestre_rotulo, m.semestre_num, m.carater, m.disciplina_codigo,
 d.nome AS disciplina_nome, coalesce(m.creditos, d.creditos) AS creditos, coalesce(m.horas, d.carga_horaria) AS horas, d.unidade_nome, d.url AS disciplina_url,
 e.texto AS ementa, o.texto AS objetivos FROM curso_matriz m JOIN curso c ON c.codigo_ufpel = m.curso_codigo
 JOIN curriculo_versao v ON v.curso_codigo = m.curso_codigo AND v.versao = m.versao JOIN disciplina d ON d.codigo = m.disciplina_codigo
 LEFT JOIN disciplina_conteudo e ON e.disciplina_codigo = d.codigo AND e.secao_slug = 'ementa'
 LEFT JOIN disciplina_conteudo o ON o.disciplina_codigo = d.codigo AND o.secao_slug = 'objetivos'""")
view("vw_matriz_versao", "curso curriculo_versao curso_matriz", """
SELECT v.curso_codigo, v.versao, v.is_atual, c.nome AS curso_nome, count(m.disciplina_codigo) AS n_disciplinas, coalesce(sum(m.creditos), 0) AS creditos_totais,
 coalesce(sum(m.horas), 0) AS horas_totais, count(*) FILTER (m.bloco = 'semestre') AS n_obrigatorias, count(*) FILTER (m.bloco = 'optativas') AS n_optativas
FROM curriculo_versao v JOIN curso c ON c.codigo_ufpel = v.curso_codigo LEFT JOIN curso_matriz m ON m.curso_codigo = v.curso_codigo AND m.versao = v.versao GROUP BY 1, 2, 3, 4""")
view("vw_projeto_professor", "projeto servidor_projeto servidor", """
SELECT p.*, x.servidor_id, x.papel, x.ch_semanal, s.nome AS professor_nome, s.lotacao_nome AS professor_lotacao
FROM projeto p LEFT JOIN servidor_projeto x USING (projeto_id) LEFT JOIN servidor s ON s.servidor_id = x.servidor_id""")
view("vw_port_noticia", "port_post port_autor port_categoria port_post_categoria port_tag port_post_tag", """
SELECT p.post_id, p.titulo, p.url, p.data_publicacao, p.ano, p.mes, p.resumo, a.nome AS autor,
 coalesce((SELECT list_sort(list(c.nome)) FROM port_post_categoria x JOIN port_categoria c USING (categoria_id) WHERE x.post_id = p.post_id), []) AS categorias,
 coalesce((SELECT list_sort(list(g.nome)) FROM port_post_tag x JOIN port_tag g USING (tag_id) WHERE x.post_id = p.post_id), []) AS tags
FROM port_post p LEFT JOIN port_autor a USING (autor_id)""",
     "post_id, titulo, url, data_publicacao, ano, mes, resumo, autor, categorias, tags")
view("vw_port_pagina", "port_pagina port_secao", """
SELECT pagina_id, titulo, url, caminho, nivel, idioma, data_modificacao, n_palavras, s.nome AS secao, secao_slug, resumo FROM port_pagina LEFT JOIN port_secao s USING (secao_slug)""")
view("vw_port_calendario", "port_calendario_evento port_pagina", """
SELECT evento_id, data, e.ano, e.mes, dia_semana, descricao, tipo, e.url, p.titulo AS calendario FROM port_calendario_evento e JOIN port_pagina p USING (pagina_id)""")
view("vw_port_faq", "port_faq port_pagina", """
SELECT faq_id, secao, pergunta, resposta, f.url, p.titulo AS pagina FROM port_faq f JOIN port_pagina p USING (pagina_id)""")
view("vw_ppgc_edital", "ppgc_edital ppgc_edital_documento", """
SELECT e.*, coalesce(d.n, 0)::INT AS n_documentos, d.pdf AS url_edital_pdf FROM ppgc_edital e
LEFT JOIN (SELECT edital_id, count(*) AS n, max(url) FILTER (tipo_documento = 'edital') AS pdf FROM ppgc_edital_documento GROUP BY 1) d USING (edital_id)""")
view("vw_ppgc_edital_mais_recente", "ppgc_edital", """
SELECT edital_id, titulo, tipo, nivel, ano, semestre, periodo_letivo, numero_oficial, url, data_publicacao FROM (
 SELECT *, row_number() OVER (PARTITION BY tipo, coalesce(nivel, '-') ORDER BY ano DESC, coalesce(semestre, 0) DESC, coalesce(data_publicacao, DATE '0001-01-01') DESC, edital_id) AS r
 FROM ppgc_edital WHERE ano IS NOT NULL) WHERE r = 1""")
view("vw_ppgc_edital_documento", "ppgc_edital ppgc_edital_documento ppgc_documento", """
SELECT x.edital_id, e.titulo AS edital, e.tipo, e.nivel, e.ano, e.semestre, x.tipo_documento, x.titulo AS documento, x.secao, x.url, d.extensao, d.data_upload,
 d.texto_extraido IS NOT NULL AS texto_disponivel FROM ppgc_edital_documento x JOIN ppgc_edital e USING (edital_id) JOIN ppgc_documento d ON d.url = x.url""")
view("vw_ppgc_normativo_vigente", "ppgc_normativo", """
SELECT normativo_id, tipo, numero, ano, titulo, ementa, coalesce(url_pagina, url_pdf) AS url, url_pdf, texto IS NOT NULL AS tem_texto_integral
FROM ppgc_normativo WHERE coalesce(vigente, false)""")
view("docente_servidor", "ppgc_docente servidor", """
SELECT docente_id, d.nome, servidor_id, s.nome AS servidor_nome FROM ppgc_docente d JOIN servidor s USING (servidor_id)""",
     "docente_id, nome, servidor_id, servidor_nome")

CLASSES_SQL = """h AS (SELECT turma_id, string_agg(dia_semana || ' ' || left(hora_inicio, 5) || '-' || left(hora_fim, 5), ', ' ORDER BY ordem) AS horarios FROM turma_horario GROUP BY 1),
p AS (SELECT turma_id, list_sort(list(DISTINCT nome)) AS professores, list_sort(list(DISTINCT servidor_id) FILTER (servidor_id IS NOT NULL)) AS ids FROM turma_professor GROUP BY 1),
b AS (SELECT t.*, d.nome AS disciplina_nome, d.creditos, d.carga_horaria, horarios, coalesce(professores, []) AS professores, coalesce(ids, []) AS professores_ids
 FROM turma t JOIN disciplina d ON d.codigo = t.disciplina_codigo LEFT JOIN h USING (turma_id) LEFT JOIN p USING (turma_id))"""
view("vw_turma_completa", "turma disciplina turma_horario turma_professor turma_curriculo curso", f"""
, {CLASSES_SQL} SELECT b.turma_id, ano, semestre, codigo_turma, vagas, matriculados, disciplina_codigo, disciplina_nome, x.curso_codigo, c.nome AS curso_nome, versao, semestre_rotulo, semestre_num,
 professores, professores_ids, horarios FROM b LEFT JOIN (SELECT DISTINCT * FROM turma_curriculo) x ON x.turma_id = b.turma_id LEFT JOIN curso c ON c.codigo_ufpel = x.curso_codigo""")
view("vw_turma", "turma disciplina turma_horario turma_professor turma_curriculo curso", f"""
, {CLASSES_SQL}, x AS (SELECT turma_id, list_sort(list(DISTINCT nome) FILTER (nome IS NOT NULL)) AS cursos, list_sort(list(DISTINCT curso_codigo)) AS cursos_codigos, list_sort(list(DISTINCT versao)) AS versoes,
 list_sort(list(DISTINCT semestre_rotulo)) AS semestres_rotulo, min(semestre_num) AS semestre_num FROM turma_curriculo LEFT JOIN curso ON codigo_ufpel = curso_codigo GROUP BY 1)
SELECT turma_id, ano, semestre, codigo_turma, vagas, matriculados, disciplina_codigo, disciplina_nome, creditos, carga_horaria, coalesce(cursos, []) AS cursos, coalesce(cursos_codigos, []) AS cursos_codigos,
 coalesce(versoes, []) AS versoes, coalesce(semestres_rotulo, []) AS semestres_rotulo, semestre_num, professores, professores_ids, horarios FROM b LEFT JOIN x USING (turma_id)""")
view("vw_port_documento", "port_documento", "SELECT * FROM port_documento")
view("vw_ppgc_agenda", "ppgc_calendario_evento", "SELECT * EXCLUDE (situacao) FROM ppgc_calendario_evento WHERE situacao IS DISTINCT FROM 'cancelled'")
view("vw_ppgc_requisito", "ppgc_requisito", "SELECT * FROM ppgc_requisito")
view("pdf_chunk_context", "ppgc_documento_chunk ppgc_documento ppgc_edital_documento ppgc_edital", """
, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ordem, edital_id) AS r FROM ppgc_edital_documento) WHERE r = 1)
SELECT c.documento_url AS url, c.ordem, c.texto, d.titulo AS documento_titulo, f.tipo_documento, e.titulo AS edital_titulo, f.edital_id
FROM ppgc_documento_chunk c JOIN ppgc_documento d ON d.url = c.documento_url LEFT JOIN f ON f.url = d.url LEFT JOIN ppgc_edital e ON e.edital_id = f.edital_id""",
     "url, ordem, texto, documento_titulo, tipo_documento, edital_titulo, edital_id")
