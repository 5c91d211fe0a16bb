"""What the page parsers ask of tasks: bounded pieces, dealt rows, one parse of each page."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vereda.functions import text as T
from vereda.operators import extract as X
from vereda.plans import parsed
from vereda.sources import elements as E


def test_elements_leave_in_bounded_pieces():
    pages = [None, "<ul>" + "<li><a href='/x'>um item</a></li>" * 5000 + "</ul>", "<p>fim</p>"]
    got = list(E._batches(pa.array([1, 2, 3], pa.int64()), pa.array(pages)))
    assert len(got) > 2 and max(b.num_rows for b in got) <= E.HELD_ROWS
    want = [(k, r["pos"], r["text"]) for k, p in zip((1, 2, 3), pages) for r in E.flatten(p)]
    assert [(r["key"], r["pos"], r["text"]) for b in got for r in b.to_pylist()] == want


def test_small_tables_become_pages_in_every_core(spark):
    table = spark.range(0, 1000, 1, 1).select("id", F.lit("x").alias("name"))
    pages = parsed._pages(table, "id", "<p>", F.col("name"), "</p>")
    cores = spark.sparkContext.defaultParallelism
    assert pages.rdd.getNumPartitions() >= cores and pages.count() == 1000


PARSERS = {"cards": X.cards, "table_records": X.table_records, "calendar": X.calendar, "groups": X.groups, "requirements": X.requirements,
           "subjects": X.subjects, "bibliography": X.bibliography, "seats": X.seats}


@pytest.mark.parametrize("name", PARSERS)
def test_a_page_is_parsed_once(spark, name):
    pages = spark.createDataFrame([(1, "<p>a</p>")], "page_id long, html string")
    plan = PARSERS[name](E.elements(pages))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_cards_move_only_what_they_read(spark):
    html = ("<div><p>um texto longo</p><div class='oculta-exibe'><span class='ficha-label'>Velho:</span><span class='ficha-campo'>x</span></div>"
            "<div><span class='ficha-label'>Cargo:</span><span class='ficha-campo'><a href='/c'>Novo</a></span></div></div>")
    cards = X.cards(E.elements(spark.createDataFrame([(1, html)], "page_id long, html string")))
    below = cards._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
    assert len(below) == 2 and "Filter" in below[1]
    assert [(r["key"], r["value"], r["href"]) for r in cards.collect()] == [("cargo", "Novo", "/c")]


def test_tidy_skips_only_what_it_would_not_change(spark):
    odd = ["", " ", "a", "a b", "a  b", "a\tb", "a \n b", "a\nb", "a , b", "( a )", "a )", "a &amp; b", "&", " a", "a ", " ", "a​b", "a\u0001b",
           "xy", "[ z", "a !", "a b", "\na", "a\n", "ação", "a. b", "(a)", "a\x0b", "\x0ba", "a\rb", "\ra", "a ", "a\n\nb", "1 %", "a\x85"]
    rows = spark.createDataFrame([(x,) for x in odd] + [(None,)], "t string").select(
        "t", T.tidy("t").alias("got"), T._tidied(F.coalesce("t", F.lit(""))).alias("want")).collect()
    assert [r for r in rows if r["got"] != r["want"]] == []


def test_pieces_of_a_batch_are_packed_as_they_come(monkeypatch):
    from vereda.operators import chunk as C
    texts = [None, "", "a b " * 400, "uma frase. " * 90, None]
    monkeypatch.setattr(C, "HELD_CHARS", 1000)
    want = [None if t is None else C.split_recursive(t, 200, 20) for t in texts]
    assert C._split_all(pa.array(texts), 200, 20).to_pylist() == want
    assert C._split_all(pa.array([], pa.string()), 200, 20).to_pylist() == []
