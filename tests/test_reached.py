import json

import pytest

from vereda.operators import calls, frontier, relate

TOOLS = {"f": ["a", "b"]}


def read(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "name long, text string")
    rows = rows.withColumnRenamed("name", "id")
    return sorted(tuple(r) for r in calls.parsed(rows, "text", TOOLS).collect())


def call(body):
    return f"<|tool_call_start|>{body}<|tool_call_end|>"


@pytest.mark.parametrize("body, want", [
    ("f(1, b='x')", [("f", {"a": 1, "b": "x"}, None)]),
    ("[f(a={'k': [1, None, True]}), g(z=-2.5)]", [("f", {"a": {"k": [1, None, True]}}, None), ("g", {"z": -2.5}, None)]),
    ("f(1, 2, 3)", [("f", {"a": 1, "b": 2}, None)]),
    ("g(1)", [("g", {}, None)]),
    ("f(g(x), b=c + 1)", [("f", {"a": "g(x)", "b": "c + 1"}, None)]),
    ("f(b={[]}, a=1e999)", [("f", {"b": "{[]}", "a": "1e309"}, None)]),
    ("f(a={2, 1}, **more)", [("f", {"a": [1, 2], "**": "more"}, None)]),
    ("f('ação \\'x\\'\\n')", [("f", {"a": "ação 'x'\n"}, None)]),
    ("[]", []),
    ("'texto'", [(None, None, "not a call")]),
    ("a.f(1)", [(None, None, "not a call")]),
    ("f(1", [(None, None, "syntax")]),
    ("", [(None, None, "syntax")]),
    ("f(a='\0')", [(None, None, "syntax")]),
])
def test_calls(spark, body, want):
    got = read(spark, [call(body)])
    assert [(n, json.loads(a) if a else None, r) for _, _, _, n, a, r in got] == want
    assert [(i, b, c) for i, b, c, *_ in got] == [(0, 0, k) for k in range(len(want))]


def test_calls_of_awkward_texts(spark):
    deep = call("f(a=" + "-" * 100_000 + "1)")
    long = call("f(a='" + "x" * 2_000_000 + "')")
    got = read(spark, [None, "", "sem chamada", "<|tool_call_start|>f()", call("f()") + " e " + call("g()"), deep, long])
    assert [r[:2] + r[3:4] for r in got if r[0] < 5] == [(4, 0, "f"), (4, 1, "g")]
    assert [r[5] for r in got if r[0] == 5] in (["nested too deep"], ["syntax"])
    assert [len(json.loads(r[4])["a"]) for r in got if r[0] == 6] == [2_000_000]
    plain = spark.createDataFrame([(f" antes {call('f()')}\n",), (None,)], "text string").select(calls.without_calls("text"))
    assert [r[0] for r in plain.collect()] == ["antes", None]


def walk(pages, seeds):
    """Addresses with their least distance."""
    out, now, depth = {}, set(seeds), 0
    while now:
        out |= dict.fromkeys(now, depth)
        now = {t for s, t in pages if s in now} - set(out)
        depth += 1
    return out


def test_frontier_with_cycles_repeats_and_missing_pages(spark):
    import random
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(70)) for _ in range(110)] + [(k, 0) for k in range(60)]
    at = "http://h/p/{}".format
    rows = [(at(s), f"<a href='/p/{t}#x'>a</a><a href='/p/{t}'>b</a>") for s, t in pairs]
    rows += [(None, "<a href='/p/1'>n</a>"), (at(3), None), (at(4), ""), (at(1), "<a href='mailto:a@b'>m</a>")]
    pages = spark.createDataFrame(rows, "url string, html string")
    want = walk([(at(s), at(t)) for s, t in pairs] + [(at(1), "mailto:a@b")], [at(5), at(6)])
    seeds = spark.createDataFrame([(at(5),), (at(6),), (at(5) + "#y",), (None,)], "url string")
    got = frontier.reached(pages, seeds).collect()
    assert {r.url: r.depth for r in got} == want and len(got) == len(want)
    stored = {r[0] for r in rows}
    assert all(r.fetched == (r.url in stored) for r in got)
    two = frontier.reached(pages, seeds, rounds=1).collect()
    assert {r.url: r.depth for r in two} == {u: d for u, d in want.items() if d <= 1}


def test_frontier_keeps_only_links_that_it_can_follow(spark, tmp_path, monkeypatch):
    """Links of pages that are no seed and that nothing leads to are read once, not in every round."""
    monkeypatch.setattr(frontier.session, "run_folder", lambda *_: str(tmp_path))
    rows = [("http://h/a", "<a href='/b'>x</a>"), ("http://h/b", "<a href='/c'>x</a>")] + [(f"http://h/n{i}", "<a href='/b'>x</a>") for i in range(50)]
    pages = spark.createDataFrame(rows, "url string, html string")
    got = frontier.reached(pages, spark.createDataFrame([("http://h/a",)], "url string")).collect()
    assert sorted(tuple(r) for r in got) == [("http://h/a", 0, True), ("http://h/b", 1, True), ("http://h/c", 2, False)]
    assert spark.read.parquet(str(tmp_path / "edges")).count() == 52
    kept = spark.read.schema("source string, target string, linked boolean, seed boolean").parquet(str(tmp_path / "followed")).collect()
    assert sorted((r.source, r.seed, r.linked) for r in kept) == [("http://h/a", True, False), ("http://h/b", False, True)]


def test_a_link_is_resolved_once(spark):
    """Neither filters on the addresses nor the cases of a link repeat the expressions that make them."""
    pages = spark.createDataFrame([("http://h/a", "<a href='/b'>x</a>")], "url string, html string")
    plan = frontier.edges(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(html") == 1


def test_frontier_of_empty_tables_and_rules(spark):
    pages = spark.createDataFrame([("http://h/cursos/cod/1", "<a href='/servidores/id/2'>x</a><a href='/outra'>y</a>")], "url string, html string")
    seeds = spark.createDataFrame([("http://h/cursos/cod/1",)], "url string")
    got = frontier.reached(pages, seeds, rules=frontier.COURSES).collect()
    assert sorted(tuple(r) for r in got) == [("http://h/cursos/cod/1", 0, True), ("http://h/servidores/id/2", 1, False)]
    assert [tuple(r) for r in frontier.reached(pages.limit(0), seeds).collect()] == [("http://h/cursos/cod/1", 0, False)]
    assert frontier.reached(pages, seeds.limit(0)).count() == 0


def test_team_members(spark):
    projects = spark.createDataFrame([(1, ["Ana Sá — aluna — 2h", "BIA", None]), (2, ["ana sá", "Ana Sá — x"]), (3, []), (4, None), (5, ["Ana Sá - x"])], "project long, team array<string>")
    people = spark.createDataFrame([(7, "ANA SÁ"), (8, "Ana sá"), (9, "bia"), (10, None)], "person long, name string")
    got = sorted(tuple(r) for r in relate.team_members(projects, people).collect())
    assert got == [(1, 7), (1, 8), (1, 9), (2, 7), (2, 8)]
