"""Facet metadata and the name tool on awkward tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vereda.operators import chunk, facets
from vereda.plans import tools


def test_metadata_of_pieces(spark):
    df = spark.createDataFrame([(1, "palavra " * 600, "a"), (2, "um texto curto mas bastante longo para passar", None), (3, None, "b")], "k int, t string, m string")
    meta = F.create_map(F.lit("tipo"), F.col("m"))
    own = chunk.facets(df, "k", scope=F.lit("s"), title=F.lit("T"), text=F.col("t"), metadata=meta).orderBy("key", "chunk").collect()
    assert [r["metadata"] for r in own] == [*[{"tipo": "a", "chunk": str(i), "chunks": "3"} for i in (1, 2, 3)], {"tipo": None, "chunk": "1", "chunks": "1"}]
    portal = chunk.portal_facets(df, "k", scope=F.lit("s"), title=F.lit("T"), text=F.col("t"), metadata=meta).orderBy("key", "chunk").collect()
    assert [r["metadata"] for r in portal] == [*[{"tipo": "a", "chunk": str(i)} for i in (0, 1, 2)], {"tipo": None}]
    assert "metadata" not in chunk.facets(df, "k", scope=F.lit("s"), title=F.lit("T"), text=F.col("t")).columns


def test_pieces_of_pdfs(spark):
    t = {"ppgc_documento": spark.createDataFrame([("u", "Arquivo"), ("v", None)], "url string, titulo string"),
         "ppgc_edital": spark.createDataFrame([(1, "Edital um"), (2, "Edital dois")], "edital_id int, titulo string"),
         "ppgc_edital_documento": spark.createDataFrame([("u", 2, 5, "anexo"), ("u", 1, 3, "resultado")], "url string, edital_id int, ordem int, tipo_documento string"),
         "ppgc_documento_chunk": spark.createDataFrame([("u", 0, "primeira"), ("u", 1, None), ("v", 0, "outra")], "url string, ordem int, texto string")}
    assert {r[0] for r in facets.build(t).select("source").distinct().collect()} == {"ppgc_edital", "ppgc_documento"}
    got = {(r["key"], r["scope"]): r for r in facets.build(t, ["ppgc_documento"]).collect()}
    assert set(got) == {("u", "pdf#0"), ("u", "pdf#1"), ("v", "pdf#0")}
    first = got["u", "pdf#0"]
    assert first["text"].split("\n")[1:] == ["Arquivo: Arquivo", "Tipo: Resultado", "Edital: Edital um", "primeira"] and first["id"] == "ppgc_documento/u/pdf#0"
    assert first["metadata"]["edital"] == "Edital um" and first["metadata"]["pagina_pdf"] is None
    assert got["v", "pdf#0"]["title"] == "v" and got["u", "pdf#1"]["text"].endswith("Edital: Edital um")


def test_class_of_unknown_subject(spark):
    t = {"turma": spark.createDataFrame([(1, 2024, 1, "M1", "22", 40, 3), (2, 2024, 1, "M2", "99", None, None)],
                                        "turma_id int, ano int, semestre int, codigo_turma string, disciplina_codigo string, vagas int, matriculados int"),
         "disciplina": spark.createDataFrame([("22", "Redes", "/d")], "codigo string, nome string, url string"),
         "curso": spark.createDataFrame([], "codigo_ufpel string, nome string"),
         "turma_horario": spark.createDataFrame([], "turma_id int, ordem int, dia_semana string, hora_inicio string, hora_fim string"),
         "turma_professor": spark.createDataFrame([(1, 7, "Ana")], "turma_id int, servidor_id int, nome string"),
         "turma_curriculo": spark.createDataFrame([], "turma_id int, curso_codigo string, versao string, semestre_rotulo string, semestre_num int")}
    got = {r["key"]: r for r in facets.build(t, ["turma"]).collect()}
    assert got["1"]["title"] == "Turma M1 de Redes (2024/1)" and got["1"]["url"] == "/d" and "Professores: Ana" in got["1"]["text"]
    assert got["2"]["title"] == "Turma M2 de 99 (2024/1)" and got["2"]["url"] is None and got["2"]["metadata"]["cursos"] == "[]"


def test_find_names(spark):
    t = {"servidor": spark.createDataFrame([(i, "Ana Souza", f"/s/{i}") for i in range(9)] + [(20, "Bruno Lima", None), (21, None, "/s/21")],
                                           "servidor_id int, nome string, url string"),
         "projeto": spark.createDataFrame([(1, "Análise de dados")], "projeto_id int, titulo string")}
    asked = spark.createDataFrame([("ana souza",), ("zzz",), ("",)], "text string")
    rows = tools.find_names(t, asked, top_k=4).orderBy("question", "rank").collect()
    assert [(r["question"], r["entity"], r["key"], r["url"]) for r in rows] == [("ana souza", "servidor", str(i), f"/s/{i}") for i in range(4)]
    assert tools.find_names(t, asked, "projeto").filter("question = 'zzz'").count() == 0
    with pytest.raises(ValueError):
        tools.find_names(t, asked, "outra")
    assert tools.resolve_entities("institucional") == ["curso", "disciplina", "servidor", "projeto"] and len(tools.resolve_entities("todas")) == 13


def test_notices_read_their_files_once_and_cut_each_text_once(spark):
    t = {"ppgc_edital": spark.createDataFrame([(1, "Edital um", "texto " * 500), (2, "Edital dois", None)], "edital_id int, titulo string, texto string"),
         "ppgc_edital_documento": spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, None, 1)], "edital_id int, titulo string, ordem int")}
    built = facets.build(t, ["ppgc_edital"])
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    # One mark of the text, in the only expression that makes it.
    assert plan.count("Documentos anexos") == 1 and plan.count("Join") == 1
    got = {(r["key"], r["chunk"]): r for r in built.collect()}
    assert "Documentos anexos:\n  - Documento: a\n  - Documento: b" in got["1", 0]["text"] and got["1", 1]["text"].startswith("Edital do ")
    assert got["1", 0]["metadata"]["n_documentos"] == "2" and "Documentos anexos" not in got["2", 0]["text"] and got["2", 0]["metadata"]["n_documentos"] == "1"
