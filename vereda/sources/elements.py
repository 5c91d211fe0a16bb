"""Pages as rows of elements.

A small parser turns one page into a flat list of elements; everything that
gives them meaning (tables, cards, calendars, questions) is a Spark plan over
those rows, see operators.extract.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import text as T

SCHEMA = ("pos int, stop int, parent int, tbl int, tag string, cls string, id string, name string, "
          "href string, title string, text string, leaf boolean")
# Elements and characters of text that a task holds before it hands them on; they bound memory, not results.
HELD_ROWS, HELD_CHARS = 4096, 1 << 22
VOID = {"br", "img", "hr", "meta", "input", "link", "col", "source", "wbr", "area", "base", "embed"}
SKIPPED = {"script", "style", "noscript", "svg", "head"}
BLOCK = {"p", "li", "ul", "ol", "table", "div", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article"}
TEXTUAL = {"p", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "a", "strong", "b", "span", "dt", "dd", "label"}
IMPLIED_END = {"li": {"li", "p"}, "p": {"p"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"},
               **{h: {"p"} for h in ("h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "div")}}


class _Flat(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open, self.muted = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.muted += 1
        if tag == "br":
            self.handle_data("")
        if tag in VOID or self.muted:
            return
        while self.open and self.open[-1]["tag"] in IMPLIED_END.get(tag, ()):
            self._close()
        a = dict(attrs)
        table = next((r["pos"] for r in reversed(self.open) if r["tag"] == "table"), None)
        row = {"pos": len(self.rows), "stop": None, "parent": self.open[-1]["pos"] if self.open else None, "tbl": table,
               "tag": tag, "cls": a.get("class"), "id": a.get("id"), "name": a.get("name"), "href": a.get("href"),
               "title": a.get("title"), "text": [], "leaf": True}
        if tag in BLOCK:
            for r in self.open:
                r["leaf"] = False
        self.rows.append(row)
        self.open.append(row)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.muted = max(0, self.muted - 1)
        elif any(r["tag"] == tag for r in self.open):
            while self.open[-1]["tag"] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if not self.muted and data.strip():
            for r in self.open:
                r["text"].append(data.strip(" \t\r\n"))

    def _close(self):
        self.open.pop()["stop"] = len(self.rows) - 1

    def finish(self):
        self.close()
        while self.open:
            self._close()
        for r in self.rows:
            r["text"] = " ".join(r["text"]) if r["tag"] in TEXTUAL or r["leaf"] else None
        return self.rows


def flatten(html: str | None) -> list[dict]:
    parser = _Flat()
    parser.feed(html or "")
    return parser.finish()


def _batches(keys: pa.Array, pages: pa.Array) -> Iterator[pa.RecordBatch]:
    """The elements of one batch of pages, in pieces of bounded size."""
    fields = [pa.field("key", keys.type), *[pa.field(n, {"int": pa.int32(), "boolean": pa.bool_()}.get(t, pa.string()))
                                            for n, t in (c.split(" ") for c in SCHEMA.split(", "))]]
    at, rows, chars = [], [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *[
            pa.array([r[f.name] for r in rows], f.type) for f in fields[1:]]], schema=pa.schema(fields))

    for i in range(len(pages)):
        for row in flatten(pages[i].as_py()):
            at.append(i)
            rows.append(row)
            chars += len(row["text"] or "")
            if len(rows) >= HELD_ROWS or chars >= HELD_CHARS:
                yield piece()
                at, rows, chars = [], [], 0
    if rows:
        yield piece()


def elements(pages: DataFrame, key: str = "page_id", html: str = "html", keep: bool = False) -> DataFrame:
    """One row per element: `key`, pos, stop, parent, tbl, tag, cls, ... , text.

    `keep` stores the rows as columns, for parsers that read them several times.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batches(b.column(0), b.column(1))

    src = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    rows = src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("key", key)
    rows = rows.withColumn("text", T.tidy("text"))
    if not keep:
        return rows
    spark, path = pages.sparkSession, session.run_folder(pages.sparkSession, "elements")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
