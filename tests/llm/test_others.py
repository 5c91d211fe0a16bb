"""Wrappers, neighbours and the pipeline."""

import json

import numpy as np
import pytest

from vereda.llm import ann, catalog, wrappers

SMALL = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><script>if (a<b) {{ "</p>" }}</script><style>p{{}}</style></head><body>
<header>Site</header><nav><ul>{menu}</ul></nav><div class="cookie-notice">We use cookies</div><div class=ad>Buy {n}</div>
<{box}><h1>Head &amp; {n}</h1>{body}<form><p>Your mail</p><input></form><aside>More</aside></{end}>
<div id="comments"><p>Reader {n} says a lot of things here, at length.</p></div><footer>&copy; {n}</footer></body></html>"""


def page(n, box="article", paragraphs=3):
    body = "".join(f"<p>Text <b>bold</b>ly   {n}.{k} caf&eacute; &#233; with many words to read.</p>" + ("<br>" if k % 2 else "") for k in range(paragraphs))
    menu = "".join(f"<li><a href='/{k}'>Menu {n}{k}</a></li>" for k in range(2 + n % 4))
    return PAGE.format(n=n, box=box, end=box.split()[0], body=body, menu=menu)


def text(n, paragraphs=3):
    return " ".join([f"Head & {n}", *(f"Text boldly {n}.{k} café é with many words to read." for k in range(paragraphs))])


@pytest.mark.parametrize("box", ["article", "main", 'div class="content"', "div class='x7'"])
def test_wrapper_main_text(spark, box):
    rows = [(i, f"http://host{i % 2}.example.com/p/{i}", page(i, box, 1 + i % 5), "x") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in wrappers.main_text(pages).collect()}
    assert {i: got[i].text for i in range(12)} == {i: text(i, 1 + i % 5) for i in range(12)}
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_wrapper_awkward(spark):
    rows = [(1, "http://a/1", None), (2, None, ""), (None, "http://a/2", page(2)), (4, "not a url", page(4)), (4, "not a url", page(4)),
            (5, "http://a/5", "<p>only one &lt; two"), (6, "http://a/6", "plain"), (7, "http://b/7", "<div " * 2_000 + "x" * 100),
            (8, "http://b/8", f"<article>{'<p>long text here</p>' * 20_000}</article>"), (9, "http://b/9", "<<>><a b='c>d</x><!-- open")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = wrappers.main_text(pages).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r.text)
    assert by[1] == [""] and by[2] == [""] and by[None] == [text(2)] and by[4] == [text(4)] * 2
    assert by[5] == ["only one < two"] and by[6] == ["plain"] and by[8] == [" ".join(["long text here"] * 20_000)]
    assert wrappers.main_text(pages.limit(0)).count() == 0


def test_wrapper_inference():
    """Repetition, repeated groups and options."""
    a, b = (wrappers._copy(wrappers.parse(x)) for x in ("<ul><li>1<li>2</ul><dl><dt>a<dd>b<dt>c<dd>d</dl>", "<ul><li>1</ul><p>x</p><dl><dt>a<dd>b</dl>"))
    w = wrappers.merge(a, b)
    assert [(x[wrappers.SIG], x[wrappers.OPT], x[wrappers.REP]) for x in w[wrappers.ITEMS]] == [("ul", False, False), ("p", True, False), ("dl", False, False)]
    assert w[wrappers.ITEMS][0][wrappers.ITEMS][0][wrappers.REP]
    assert any(x[wrappers.REP] and x[wrappers.SIG].startswith("(dt dd") for x in w[wrappers.ITEMS][2][wrappers.ITEMS])
    assert json.loads(json.dumps(w)) == w


def test_given_pages(spark):
    import html
    import re

    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r.page_id: r.text for r in catalog.QUERIES["op6_wrappers"](spark, SMALL).collect()}
    for r in rows:
        body = re.sub(r"</?b>", "", r.html[r.html.index("<article>"):r.html.index("</article>")])
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())


def test_neighbours_recall(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    ids, vec = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    got = {}
    for r in catalog.QUERIES["op10_ann"](spark, SMALL).collect():
        got.setdefault(r.query_id, []).append(r)
    hits = total = 0
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    for q, found in got.items():
        near = unit @ unit[ids == q][0]
        near[ids == q] = -9
        want = ids[np.lexsort((ids, -near))[:5]].tolist()
        found = sorted(found, key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5] and all(r.score == pytest.approx(near[ids == r.vec_id][0]) for r in found)
        hits, total = hits + len(set(want) & {r.vec_id for r in found}), total + 5
    assert hits >= 0.95 * total


def test_neighbours_awkward(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(i, one) for i in range(0, 400)] + [(1000, [3.0, 2.0, 1.0]), (1001, [2.0, 4.0, 6.0]), (1050, None), (1051, []), (1100, [0.0, 0.0, 0.0]), (1101, [1.0, None, 2.0]),
                                                 (1102, [float("nan"), 1.0, 1.0]), (1103, [float("inf"), 1.0, 1.0]), (None, one), (1150, [1.0, 2.0]), (0, one)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "'x' AS vec", "0 AS shard")
    got = {}
    for r in ann.digest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == {0, 50, 100, 150, 200, 250, 300, 350, 1000}
    assert sorted(got[50]) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert sorted(got[0]) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert len(got[1000]) == 5
    assert ann.digest(df.limit(0)).count() == 0


def test_neighbours_over_shards(spark):
    vec = np.random.default_rng(0).normal(size=(600, 16))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vec.tolist())], "vec_id long, vec array<double>")
    got = ann.nearest(df, df.filter("vec_id % 50 = 0"), shard=150, block=5).collect()
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    hits = 0
    for r in got:
        near = unit @ unit[r.query_id]
        near[r.query_id] = -9
        hits += r.vec_id in np.argsort(-near)[:5]
    assert len(got) == 60 and hits >= 57


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "mixing", "byte_bpe"]
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, SMALL)
        assert state.columns == docs.columns, name
    rows = corpus_pipeline.run(spark, SMALL).collect()
    path, pattern = catalog.public_vocabulary()
    from vereda.llm import bpe

    codec = bpe.Codec(bpe.read_ranks(path), pattern)
    texts = {r.doc_id: r.text for r in state.collect()}
    assert len(rows) == state.count()
    assert all(codec.decode(r.ids).decode() == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)


MIXES = ["h2 p h2 p ul h2 p", "h1 p h2 p p h2 p ul p h2 p", "p h2 p h2 p table h2 p h2 p table blockquote p", "h2 p ul h2 p ul p h2 p ul table h2 p ul p",
         "p p blockquote p p blockquote p ul blockquote p p", "h2 p h2 p div.share h2 p h2 p div.share p"]


def mix(tags, n=0):
    """A body of the blocks, and its text."""
    html, said = [], []
    for k, tag in enumerate(tags.split()):
        words = f"{tag} number {n}.{k} says something here"
        inner = {"ul": f"<li>{words} a</li><li>{words} b</li>", "table": f"<tr><td>{words} a</td><td>{words} b</td></tr>"}.get(tag, words)
        html.append("<div class=share>Share this</div>" if tag == "div.share" else f"<{tag}>{inner}</{tag}>")
        said += [] if tag == "div.share" else [f"{words} a {words} b"] if tag in ("ul", "table") else [words]
    return "".join(html), " ".join(said)


@pytest.mark.parametrize("box", ["article", "div class=x7"])
def test_wrapper_repeated_blocks(spark, box):
    """Blocks that repeat and recur keep their text, on single pages and on pages of one host."""
    import random

    rng = random.Random(3)
    mixes = MIXES + [" ".join(rng.choice("h2 p p ul table blockquote".split()) for _ in range(rng.randint(5, 25))) for _ in range(60)]
    rows, want = [], {}
    for i, tags in enumerate(mixes):
        body, want[i] = mix(tags, i)
        want[1000 + i] = want[i]
        source = f"<body><nav><a href=/>Menu</a></nav><{box}>{body}</{box.split()[0]}><footer>End</footer>"
        rows += [(i, f"http://alone{i}/", source), (1000 + i, "http://shared/", source)]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_wrapper_block_without_slot():
    """A block of links that no slot of the host's wrapper takes stays in the article."""
    w = wrappers._copy(wrappers.parse("<article><p>one two three</p></article>"))
    page = wrappers.parse("<article><p>one two three</p><ul><li><a href=x>linked</a></ul></article>")
    assert wrappers.extract(page, w, wrappers.main_block(w)) == "one two three linked"


EMBEDDED = [
    ("<svg class=i viewBox='0 0 1 1'/><p>one</p><p>two</p>", "one two"),
    ("<p>one<svg/>s</p><p>two <svg><path d=''/><text>no</text></svg>more</p>", "ones two more"),
    ("<object data=x><p>one</p><p>two</p>", "one two"),
    ("<p>one</p><select><option>no<option>no<p>two</p><h2>three</h2>", "one two three"),
    ("<p>one <svg><path d=x></p><p>two</p>", "one two"),
    ("<iframe src=x><p>one</p><template><p>two</p>", "one two"),
    ("<p>one <select><option>no</option></select> two</p><object data=x><p>no</p></object><noscript><p>no</p></noscript><p>three", "one two three"),
    ("<svg><foreignObject><p>no</p></foreignObject></svg><p>one</p>", "one"),
    ("<svg><g><text>no</text></g></svg><p>one</p><script>if (a < b) { '<p>no</p>' }</script><p>two</p>", "one two")]


@pytest.mark.parametrize("body, said", EMBEDDED)
@pytest.mark.parametrize("ahead", ["", "<object data=a>", "<svg />", "<select>"])
def test_wrapper_embedded(body, said, ahead):
    """Embedded elements that close themselves or have no end tag swallow nothing."""
    source = f"<body>{ahead}<article><h1>Head</h1>{body}</article><footer>End</footer><svg></svg>"
    assert wrappers.extract(wrappers.parse(source), None) == f"Head {said}"


@pytest.mark.parametrize("tag", ["div", "ul", "ul><li", "blockquote"])
def test_wrapper_deep_nesting(spark, tag):
    """Pages with thousands of open tags, on one host and beside a plain page of it."""
    said = [f"text {k} is here" for k in range(4000)]
    deep = "<article>" + "".join(f"<{tag}>{x} " for x in said)
    rows = [(1, "http://a/1", deep), (2, "http://a/2", deep + "<p>more of it"), (3, "http://a/3", page(3)), (4, "http://b/4", deep)]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: " ".join(said), 2: " ".join(said) + " more of it", 3: text(3), 4: " ".join(said)}


def test_neighbours_of_very_large_and_tiny_vectors(spark):
    """Any finite size of a vector gives the same cosines."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 8))
    size = np.array([1e200, 1e-200, 1.0, 1e307, 1e-300])
    rows = [(k, (base[k] * size[k % 5]).tolist()) for k in range(60)]
    got = ann.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), step=5).collect()
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    for r in got:
        assert abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-9
    assert len(got) == 12 * 5
