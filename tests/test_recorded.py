import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vereda.operators import history, records
from vereda.sources import elements
from vereda.streaming import ingest


def test_records_of_bare_and_partial_pages(spark):
    card = "<div><span class='ficha-label'>Código:</span><span class='ficha-campo'>22</span></div>"
    html = ["<p>nada</p>", f"<h1>Redes</h1><div class='ficha-dados'>{card}</div><h2>Turmas ofertadas</h2><p>nenhuma</p>",
            "<h1>Só título</h1><table><tr><td>a</td><td>b</td><td>c</td><td>d</td></tr></table>"]
    els = elements.elements(spark.createDataFrame(list(enumerate(html)), "page_id long, html string"))
    at = lambda path: F.variant_get("record", path, "string")
    got = records.subjects(els).select("page_id", "titulo", at("$.codigo"), at("$.ementa"), at("$.turmas_ofertadas"), "embedding_text").orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(0, None, None, None, "[]", "Disciplina:  (código ) — UFPel"), (1, "Redes", "22", None, "[]", "Disciplina: Redes (código 22) — UFPel"),
                                       (2, "Só título", None, None, "[]", "Disciplina: Só título (código ) — UFPel")]
    course = records.courses(els).select("page_id", "titulo", at("$.matriz_curricular"), at("$.professores")).orderBy("page_id").collect()
    assert [tuple(r) for r in course] == [(0, " ()", "[]", "[]"), (1, "Redes ()", "[]", "[]"), (2, "Só título ()", "[]", "[]")]
    assert records.subjects(els.limit(0)).count() == 0


def expected_cut(turns, limit):
    """The history of one conversation, cut result by result."""
    turns = sorted(turns)
    texts = [t for _, _, t in turns]
    total = sum(len(t or "") for t in texts)
    tools = [i for i, (_, role, _) in enumerate(turns) if role == "tool"]
    for i in tools[:-1]:
        if int(total / 3.5) <= limit:
            break
        if len(texts[i] or "") > 700:
            cut = texts[i][:600] + history.CUT_MARK
            total += len(cut) - len(texts[i])
            texts[i] = cut
    return [(t[0], text) for t, text in zip(turns, texts)]


@pytest.mark.parametrize("block", [2, 512])
def test_compaction_equals_cutting_one_by_one(spark, monkeypatch, block):
    monkeypatch.setattr(history, "BLOCK", block)
    rng = random.Random(2)
    rows = [(conv, turn, rng.choice(["user", "tool", "tool"]), rng.choice([None, "", "x" * rng.randint(1, 3000)])) for conv in (1, 2, None) for turn in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for limit in (10, 2500, 6000, 10**6):
        got = history.compacted(df, F.col("role") == "tool", max_tokens=limit).collect()
        for conv in (1, 2, None):
            want = expected_cut([(t, role, text) for c, t, role, text in rows if c == conv], limit)
            assert sorted((r.turn, r.text or "") for r in got if r.conv_id == conv) == [(t, x or "") for t, x in want]


def test_provider_chain_of_a_hot_key_equals_a_replay(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a"] * 9 + ["b", None]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(3000)), *[rng.random() < 0.98 for _ in range(4)]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, who string, ts timestamp, w0 boolean, w1 boolean, w2 boolean, w3 boolean")
    got = {r.id: (r.provider, r.primary) for r in history.provider_in_use(
        df, [F.col(f"w{k}") for k in range(4)], "who", ["ts", "id"], F.floor(F.unix_seconds("ts") / 3600)).collect()}
    for who in ("a", "b", None):
        state = 0
        for row in sorted((r for r in rows if r[1] == who), key=lambda r: (r[2], r[0])):
            served = next((k for k in range(state, 4) if row[3 + k]), None)
            assert got[row[0]] == (served, state)
            state = state if served is None else served
    assert len(got) == 600


def test_stream_ingest_repeats_a_failed_batch_without_doubling(spark, tmp_path):
    rows = [(i, ("disciplina", "projeto")[i % 2], f"texto {i}") for i in range(40)]
    schema = "doc_id long, kind string, text string"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(str(tmp_path / "landing"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "landing"))
    chunker = lambda df: df.select("doc_id", "kind", F.explode(F.split("text", " ")).alias("chunk"))
    root = str(tmp_path / "out")

    def fail(batch):
        if batch == 1:
            raise RuntimeError("lost between the sinks")

    with pytest.raises(Exception, match="lost between the sinks"):
        ingest.start(stream(), root, chunker, fail).awaitTermination()
    assert spark.read.parquet(f"{root}/typed").select("batch").distinct().count() == 2
    assert spark.read.parquet(f"{root}/collections").select("batch").distinct().count() == 1
    ingest.start(stream(), root, chunker).awaitTermination()
    typed, laid = spark.read.parquet(f"{root}/typed"), spark.read.parquet(f"{root}/collections")
    want = sorted((i, w) for i, _, text in rows for w in text.split())
    assert sorted((r.doc_id, r.chunk) for r in typed.collect()) == want == sorted((r.doc_id, r.chunk) for r in laid.collect())
    assert ingest.collection(spark, root, "ufpel_projetos").count() == 40
