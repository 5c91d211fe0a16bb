"""Views, integrity, scans, sources, tools, streaming."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from vereda import session
from vereda.operators import dedup, relate, reliability, scan, views
from vereda.plans import answer, context, tools
from vereda.sources import io, rest
from vereda.streaming import events as stream


@pytest.fixture(scope="module")
def tables(spark):
    def t(rows, ddl):
        return spark.createDataFrame(rows, ddl)
    return {
        "curso": t([("3900", "CC"), ("3910", "EC")], "codigo_ufpel string, nome string"),
        "disciplina": t([("22", "Redes", 4, 60, "DC", "u")], "codigo string, nome string, creditos int, carga_horaria int, unidade_nome string, url string"),
        "disciplina_conteudo": t([("22", "ementa", "camadas")], "disciplina_codigo string, secao_slug string, texto string"),
        "curriculo_versao": t([("3900", "1028", True), ("3910", "1001", False)], "curso_codigo string, versao string, is_atual boolean"),
        "curso_matriz": t([("3900", "1028", "22", "semestre", "1º", 1, "Obr", None, 68)],
                          "curso_codigo string, versao string, disciplina_codigo string, bloco string, semestre_rotulo string, semestre_num int, carater string, creditos int, horas int"),
        "turma": t([("T1", "22", 2026, 1, "M1", 30, 28), ("T2", "22", 2026, 1, "M2", 30, 0)],
                   "turma_id string, disciplina_codigo string, ano int, semestre int, codigo_turma string, vagas int, matriculados int"),
        "turma_curriculo": t([("T1", "3900", "1028", "1º", 1), ("T1", "3910", "1001", "2º", 2)],
                             "turma_id string, curso_codigo string, versao string, semestre_rotulo string, semestre_num int"),
        "turma_professor": t([("T1", "ANA", "1"), ("T1", "BIA", None)], "turma_id string, nome string, servidor_id string"),
        "turma_horario": t([("T1", 2, "QUA", "10:00:00", "11:40:00"), ("T1", 1, "SEG", "08:00:00", "09:40:00")],
                           "turma_id string, ordem int, dia_semana string, hora_inicio string, hora_fim string"),
        "port_menu_item": t([(1, None, "Graduação"), (2, 1, "Semana")], "item_id int, parent_item_id int, titulo string"),
        "ppgc_edital": t([("e1", "A", "regular", None, 2026, None, None, None, "u", None, None), ("e2", "B", "regular", None, 2026, 1, None, None, "u", None, None)],
                         "edital_id string, titulo string, tipo string, nivel string, ano int, semestre int, periodo_letivo string, numero_oficial string, url string, data_publicacao date, resumo string"),
        "ppgc_edital_documento": t([("e1", "edital", "p1")], "edital_id string, tipo_documento string, url string"),
    }


def test_views(spark, tables):
    full = {r["turma_id"]: r for r in views.vw_turma(tables).collect()}
    assert full["T1"]["horarios"] == "SEG 08:00-09:40, QUA 10:00-11:40"
    assert (full["T1"]["cursos"], full["T1"]["professores"], full["T1"]["professores_ids"], full["T1"]["semestre_num"]) == (["CC", "EC"], ["ANA", "BIA"], ["1"], 1)
    assert full["T2"]["cursos"] == [] and full["T2"]["horarios"] is None
    assert views.vw_turma_completa(tables).count() == 3
    d = views.vw_disciplina_curso(tables).first()
    assert (d["creditos"], d["horas"], d["ementa"], d["objetivos"]) == (4, 68, "camadas", None)
    m = {r["curso_codigo"]: r for r in views.vw_matriz_versao(tables).collect()}
    assert (m["3900"]["n_disciplinas"], m["3900"]["horas_totais"], m["3910"]["n_disciplinas"]) == (1, 68, 0)
    assert {r["caminho_titulos"] for r in views.vw_port_menu(tables).collect()} == {"Graduação", "Graduação › Semana"}
    e = {r["edital_id"]: r for r in views.vw_ppgc_edital(tables).collect()}
    assert (e["e1"]["n_documentos"], e["e1"]["url_edital_pdf"], e["e2"]["n_documentos"]) == (1, "p1", 0)
    assert views.vw_ppgc_edital_mais_recente(tables).first()["edital_id"] == "e2"
    assert views.vw_computacao_noticia(tables) is None
    assert "vw_turma" in views.register(tables)
    rows, error = tools.run_sql(spark, "SELECT turma_id FROM vw_turma ORDER BY 1;")
    assert error is None and tools.format_rows(rows).startswith("2 linha(s):\nturma_id\nT1")
    assert tools.run_sql(spark, "drop table x")[1] == "not_a_select"
    assert "vw_turma.professores" in tools.run_sql(spark, "SELECT professor FROM vw_turma")[1]
    assert tools.describe(spark, "vw_turma").count() == 18
    assert tools.view_lookup(spark, "vw_turma", {"codigo_turma": "m2", "nada": "x"}).first()["turma_id"] == "T2"


def test_cyclic_paths(spark):
    df = spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (3, 0, "c"), (4, 3, "d")], "id int, parent int, slug string")
    got = {r["item"]: r["path"] for r in relate.ancestor_paths(df, item="id", parent="parent", slug="slug").collect()}
    assert got == {1: "b/a", 2: "a/b", 3: "c", 4: "c/d"}


def test_dedup(spark):
    df = spark.createDataFrame([("k", 1, "", None), ("k", 2, "x", None), ("k", 3, "y", 1), ("k", 4, "z", 2), (None, 5, "n", None), (None, 6, "m", None)],
                               "key string, seq int, a string, b int")
    assert {r["seq"] for r in dedup.richest(df, ["key"], "seq").collect()} == {3, 5}
    m = {r["key"]: (r["a"], r["b"]) for r in dedup.merge_first(df, ["key"], "seq", ["a", "b"]).collect()}
    assert m == {"k": ("x", 1), None: ("n", None)}
    assert dedup.duplicate_keys(df, [F.coalesce("key", F.lit("-")).alias("key")]).count() == 2


def test_scans_cross_blocks(spark):
    rows = [("a", i, "m%d" % i if i % 7 == 3 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i int, m string")
    got = {r["i"]: r["lab"] for r in scan.carry_forward(df, ["k"], ["i"], F.col("m"), "lab", F.floor(F.col("i") / 4)).collect()}
    last = None
    for _, i, m in rows:
        last = m or last
        assert got[i] == last
    prev = {r["i"]: r["p"] for r in scan.previous(df, ["k"], ["i"], F.col("i"), "p", F.floor(F.col("i") / 4)).collect()}
    assert prev == {i: (i - 1 if i else None) for i in range(50)}


def log(spark):
    kinds = ["success", "failure", "failure", "success", "failure"]
    rows = [(i, f"2024-01-01 0{i}:00:00", "llm", k, 10.0) for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "event_id int, t string, component string, event string, elapsed_ms double").withColumn("ts", F.to_timestamp("t"))


def test_reliability(spark):
    ev = log(spark)
    assert reliability.mtbf(ev).first()["mtbf_s"] == 5400.0
    m = reliability.mttr(ev).first()
    assert (m["outages"], m["mttr_s"]) == (1, 7200.0)
    start = ev.agg(F.min(reliability.seconds(F.col("ts")))).first()[0]
    # down 1h-3h and from 4h on; window opens at the first failure
    assert reliability.availability(ev, F.lit(start + 5 * 3600)).first()["availability"] == round(1 - 3 / 4, 6)


def test_recorder_and_stream(spark, tmp_path):
    rec = reliability.Recorder(spark, str(tmp_path / "log"))
    with rec.request("llm", context="c"):
        pass
    with pytest.raises(ValueError):
        with rec.request("llm"):
            raise ValueError("x")
    rec.fallback("llm", "motivo")
    assert rec.flush() and reliability.summary(reliability.read_log(spark, str(tmp_path / "log"))).first()["failures"] == 1
    src = str(tmp_path / "in")
    log(spark).select("ts", "component", "event", "elapsed_ms").write.parquet(src)
    live = spark.readStream.schema("ts timestamp, component string, event string, elapsed_ms double").parquet(src)
    stream.run_available(stream.outages(live), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["component"], r["seconds"]) for r in got] == [("llm", 7200.0)]
    live = spark.readStream.schema("ts timestamp, component string, event string, elapsed_ms double").parquet(src)
    stream.run_available(stream.windowed_summary(live), str(tmp_path / "out2"), str(tmp_path / "ck2"))
    assert spark.read.parquet(str(tmp_path / "out2")).agg(F.sum("failures")).first()[0] >= 2


def test_sources(spark, tmp_path):
    q = tmp_path / "q.jsonl"
    q.write_text('# comentário\n{"pergunta": "a?"}\n\n{"id": "x", "pergunta": "b?", "deve_conter": ["c"]}\n{"pergunta": "d?"}\n', encoding="utf-8")
    assert [(r["id"], r["pergunta"]) for r in io.read_questions(spark, str(q)).orderBy("pergunta").collect()] == [("q1", "a?"), ("x", "b?"), ("q3", "d?")]
    d = tmp_path / "d.json"
    d.write_text(json.dumps([{"id": "1", "tipo": "curso", "titulo": "T", "embedding_text": "E", "metadata": {"url": "u"}},
                             {"url": "v", "title": "L", "text": io.EMPTY_TEXT, "tipo": "sobre"}]), encoding="utf-8")
    got = {r["kind"]: (r["title"], r["text"], r["url"]) for r in io.read_documents(spark, str(d)).collect()}
    assert got == {"curso": ("T", "E", "u"), "sobre": ("L", None, "v")}
    t = tmp_path / "t.json"
    t.write_text(json.dumps({"curso": [{"codigo": "1", "n": 2}], "turma": []}), encoding="utf-8")
    frames = io.read_tables(spark, str(t), {"curso": "codigo string, n int", "turma": "id string"})
    assert frames["curso"].first()["n"] == 2 and frames["turma"].isEmpty()
    (tmp_path / "bad.json").write_text("[1]", encoding="utf-8")
    with pytest.raises(ValueError):
        io.read_tables(spark, str(tmp_path / "bad.json"), {"a": "x int"})
    root = tmp_path / "rest" / "posts"
    root.mkdir(parents=True)
    (root / "total").write_text("2")
    (root / "page-1.json").write_text('[{"id": 1}, {"id": 2}]')
    (root / "page-2.json").write_text('[{"id": 3}]')
    spark.dataSource.register(rest.PagedRest)
    got = spark.read.format("paged_rest").options(root=str(tmp_path / "rest"), resource="posts").load()
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3]
    assert rest.looks_blocked(" <!DOCTYPE html>") and not rest.looks_blocked("[]")


def test_tables_on_disk(spark, tmp_path):
    path = str(tmp_path / "tab")
    rows = spark.createDataFrame([(1, "a", 10)], "k int, lang string, n int")
    io.upsert_table(spark, rows, path, ["k"])
    io.upsert_table(spark, spark.createDataFrame([(1, "b", 20), (2, "c", 30)], "k int, lang string, n int"), path, ["k"], ["lang"])
    got = spark.read.parquet(io.current_version(spark, path)).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "a", 20), (2, "c", 30)]
    ins = str(tmp_path / "ins")
    assert io.insert_ignore(spark, rows, ins, ["k"]).count() == 1
    io.insert_ignore(spark, spark.createDataFrame([(1, "z", 0), (3, "d", 1)], "k int, lang string, n int"), ins, ["k"])
    assert sorted(r["lang"] for r in spark.read.parquet(ins).collect()) == ["a", "d"]
    assert "| k |" in io.markdown(rows.select("k"))


def test_ingest(spark, tmp_path):
    from vereda.functions import embed
    from vereda.operators import chunk
    docs = spark.createDataFrame([("1", "curso", "T", "um texto"), ("2", "outro", "U", "dois textos")], "doc_id string, kind string, title string, text string")
    io.ingest(docs, str(tmp_path), lambda d: chunk.chunk(d, "doc_id", "text"), lambda c: embed.embed(c, "chunk"))
    assert io.collection(spark, str(tmp_path), "ufpel_cursos").count() == 1
    assert io.collection(spark, str(tmp_path), "ufpel_portal_geral").first()["chunk"] == "dois textos"


def test_answer_plan(spark):
    asked = spark.createDataFrame([("1", "s", 5, "mostre mais"), ("2", "s", 5, "Qual a receita de bolo?"), ("3", "t", 5, "Quem pesquisa redes na computação?"),
                                   ("4", "t", 5, "Quais disciplinas do curso de Engenharia de Computação?"), ("5", "t", 5, "Horário da biblioteca da universidade amanhã?"),
                                   ("6", "t", 5, "Projetos de extensão em computação agora")], "query_id string, session_id string, sec long, text string")
    pending = spark.createDataFrame([("s",)], "session_id string")
    got = {r["query_id"]: (r["route"], r["collection"]) for r in answer.plan(asked, pending).collect()}
    assert got == {"1": ("continuation", None), "2": ("blocked", None), "3": ("area", None), "4": ("structured", None),
                   "5": ("search_all", None), "6": ("search", "ufpel_projetos")}


def test_enrich_titles(spark):
    chunks = spark.createDataFrame([("Redes de Computadores", "disciplina", None), ("Algo distante", "disciplina", None), ("X", "curso", "9")], "title string, kind string, doc_id string")
    recs = spark.createDataFrame([("REDES DE COMPUTADORES I", "disciplina", "r1"), ("Redes de Computadores", "curso", "c1")], "title string, kind string, doc_id string")
    got = {r["title"]: r["doc_id"] for r in answer.enrich_titles(chunks, recs).collect()}
    assert got == {"Redes de Computadores": "r1", "Algo distante": None, "X": "9"}


def test_prompt(spark):
    df = spark.createDataFrame([("q?", ["c1", "c2"], "k")], "question string, chunks array<string>, collection string")
    df = df.withColumn("context", context.join_chunks(F.col("chunks"))).withColumn("n_docs", F.size("chunks"))
    p = context.prompt(df, {"z": "{question}"}, "Instrução própria").first()["prompt"]
    assert "c1\n\n---\n\nc2" in p and "q?" in p and p.startswith("Instrução própria")


def test_sources_of_tool():
    assert len(tools.resolve_sources("")) == 16 and tools.resolve_sources("portal") == ["portal_noticia", "portal_pagina", "portal_faq"]
    assert tools.resolve_sources("nada") == [] and tools.tool_schema(tools.describe)["parameters"]["required"] == ["spark", "name"]
    assert session.TABLES


def test_facets_of_entities(spark, tables):
    from vereda.operators import facets
    t = dict(tables)
    t["ppgc_normativo"] = spark.createDataFrame([("n1", "resolucao", "01", 2019, "T", "Normas de bolsas", False, "x" * 2500, None, "p.pdf"),
                                                 ("n2", "regimento", None, 2020, "Regimento do programa", None, None, None, "u", None)],
                                                "normativo_id string, tipo string, numero string, ano int, titulo string, ementa string, vigente boolean, texto string, url_pagina string, url_pdf string")
    t["disciplina_conteudo"] = t["disciplina_conteudo"].withColumn("secao", F.lit("Ementa"))
    t["ppgc_edital"] = t["ppgc_edital"].withColumn("texto", F.lit("Texto do edital"))
    t["ppgc_edital_documento"] = t["ppgc_edital_documento"].withColumn("titulo", F.lit("Edital 1")).withColumn("ordem", F.lit(1))
    out = facets.build(t)
    got = {(r["source"], r["key"], r["scope"]): r["text"] for r in out.collect()}
    assert "Horários: SEG 08:00-09:40, QUA 10:00-11:40" in got[("turma", "T1", "oferta")]
    assert "Ementa: camadas" in got[("disciplina", "22", "ficha")]
    assert "Situação: REVOGADA" in got[("ppgc_normativo", "n1", "norma#0")] and ("ppgc_normativo", "n1", "norma#1") in got
    assert "Identificação: Regimento 2020" in got[("ppgc_normativo", "n2", "norma")]
    assert "Documentos anexos:\n  - Edital: Edital 1" in got[("ppgc_edital", "e1", "edital")]
    v = spark.createDataFrame([("a", "9", False), ("a", "10", False), ("b", "3", True), ("b", "7", False)], "curso_codigo string, versao string, is_atual boolean")
    assert {r[0]: r[1] for r in facets.current_version(v).collect()} == {"a": "10", "b": "3"}


def test_scans_keep_null_keys_and_order(spark):
    rows = [("a", 1, "x"), ("a", None, "y"), ("a", 3, None), (None, 1, "z"), (None, 2, None), (None, None, None)]
    df = spark.createDataFrame(rows, "key string, at int, value string")
    block = F.floor(F.col("at") / 2)
    carried = scan.carry_forward(df, ["key"], ["at"], F.col("value"), "last", block).collect()
    assert sorted(((r["key"] or "", r["at"] or 0), r["last"]) for r in carried) == sorted([
        (("a", 0), "y"), (("a", 1), "x"), (("a", 3), "x"), (("", 0), None), (("", 1), "z"), (("", 2), "z")], key=lambda x: x[0])
    numbered = scan.numbered(df, ["key"], ["at"], "n", block).collect()
    assert {(r["key"], r["at"]): r["n"] for r in numbered} == {
        ("a", None): 1, ("a", 1): 2, ("a", 3): 3, (None, None): 1, (None, 1): 2, (None, 2): 3}
    before = scan.previous(df, ["key"], ["at"], F.col("value"), "before", block).collect()
    assert len(before) == 6


def test_projects_without_start_come_last(spark):
    people = spark.createDataFrame([(1, 10)], "question long, person long")
    projects = spark.createDataFrame([(100, 10, None), (101, 10, dt.date(2020, 1, 1)), (102, 10, dt.date(2021, 1, 1))],
                                     "project long, coordinator long, start date")
    members = spark.createDataFrame([(100, 10)], "project long, person long")
    got = relate.projects_of_people(people, projects, members, 5)
    assert {r["project"] for r in got.collect()} == {100, 101, 102}
    assert {r["project"] for r in relate.projects_of_people(people, projects, members, 2).filter("role = 'coordenador'").collect()} == {101, 102}


def test_deep_tree(spark):
    rows = [(i, i - 1 if i else None, f"t{i}") for i in range(66)]
    edges = spark.createDataFrame(rows, "item long, parent long, title string")
    assert relate.tree_paths(edges, item="item", parent="parent", title="title").agg(F.max("level")).first()[0] == 65
