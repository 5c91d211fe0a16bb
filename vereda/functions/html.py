"""HTML to text, links and sections with JVM regular expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Element and extension lists.
IGNORED = ("script", "style", "noscript", "iframe", "svg", "form", "button")
NOISE = ("script", "style", "noscript", "iframe", "nav", "header", "footer", "form", "button")
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "figcaption", "dd", "dt", "pre",
          "div", "ul", "ol", "table", "article", "section", "nav", "header", "footer", "main", "body", "figure")
DOCUMENT_EXT = ("pdf", "doc", "docx", "odt", "rtf")
SHEET_EXT = ("xls", "xlsx", "ods", "csv")
IMAGE_EXT = ("jpg", "jpeg", "png", "gif", "webp", "svg")
HOME_HOST = "wp.ufpel.edu.br"
MAX_PSEUDO_TITLE = 90
NOT_TITLES = ("pergunta", "resposta", "atencao", "obs", "observacao", "importante", "nota",
              "aviso", "fonte", "link", "links")

LINK = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""
MARK = "\u0001"


def drop_elements(c, names=NOISE) -> Column:
    """Remove comments and the named elements with their content."""
    out = F.regexp_replace(T._col(c), r"(?s)<!--.*?-->", "")
    for name in names:
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "")
    return out


def strip_tags(c) -> Column:
    return F.regexp_replace(T._col(c), r"(?s)<[^>]*>", " ")


def inline_text(c) -> Column:
    """Text of a fragment on one line per break, tags dropped."""
    t = F.regexp_replace(T._col(c), r"(?i)<br\s*/?>", "\n")
    return T.tidy(strip_tags(t))


def to_text(c, drop=IGNORED) -> Column:
    """Readable text: list items as '- x', table rows as 'a | b', blocks on own lines."""
    t = drop_elements(F.coalesce(T._col(c), F.lit("")), ("head",) + tuple(drop))
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?is)</t[dh]\s*>\s*<t[dh]\b[^>]*>", " | ")
    t = F.regexp_replace(t, r"(?i)</?tr\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?i)<li\b[^>]*>", "\n- ")
    t = F.regexp_replace(t, r"(?i)</li\s*>", "\n")
    t = F.regexp_replace(t, r"(?i)</?(%s)\b[^>]*>" % "|".join(BLOCKS), "\n")
    t = T.tidy(strip_tags(t))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & (x != "-") & ~x.rlike(r"^[| ]+$"))
    return F.array_join(kept, "\n")


# --- URLs ---------------------------------------------------------------------


def scheme(u: Column) -> Column:
    return F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)


def host(u: Column) -> Column:
    """Lower-case authority part, '' when the URL has none."""
    return F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def path(u: Column) -> Column:
    rest = F.regexp_replace(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?", "")
    return F.regexp_replace(rest, r"[?#].*$", "")


def without_fragment(u: Column) -> Column:
    return F.regexp_replace(u, r"#.*$", "")


def absolute(href: Column, base: Column) -> Column:
    """Resolve a link against the address of its page."""
    def resolved(href: Column) -> Column:
        origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
        folder = F.regexp_replace(path(base), r"[^/]*$", "")
        joined = F.when(href.startswith("/"), F.concat(origin, href)).otherwise(
            F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), href))
        return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
                .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
                .when(href.startswith("?"), F.concat(origin, path(base), href))
                .when(href == "", without_fragment(base))
                .otherwise(joined))

    def folded(u: Column) -> Column:
        return F.when(F.contains(u, F.lit("/.")) & path(u).rlike(r"/\.\.?(/|$)"), _without_dots(u)).otherwise(u)

    # The link is often a longer expression, which the cases would repeat.
    return T.let(T.let(href, resolved), folded)


def _without_dots(u: Column) -> Column:
    origin = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    tail = F.regexp_extract(u, r"([?#].*)$", 1)
    segments = F.filter(F.split(path(u), "/"), lambda s: s != "")
    folded = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, s: F.when(
        s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    ).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    end = F.when(path(u).rlike(r"(/|/\.\.?)$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(origin, F.lit("/"), F.array_join(folded, "/"),
                    F.when(F.size(folded) > 0, end).otherwise(F.lit("")), tail)


def extension(u: Column) -> Column:
    p = path(F.try_url_decode(u))
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(p, path(u)), r"\.([A-Za-z0-9]{1,5})$", 1)), F.lit(""))


def file_name(u: Column) -> Column:
    p = F.coalesce(path(F.try_url_decode(u)), path(u))
    return F.nullif(F.element_at(F.split(p, "/"), -1), F.lit(""))


def link_class(u: Column, home: str = HOME_HOST) -> Column:
    ext = extension(u)
    return (F.when(F.lower(u).startswith("mailto:"), "email")
            .when(ext.isin(*DOCUMENT_EXT), "documento").when(ext.isin(*SHEET_EXT), "planilha")
            .when(ext.isin(*IMAGE_EXT), "imagem")
            .when((host(u) == "") | host(u).endswith(home), "interno").otherwise("externo"))


def allowed_host(u: Column, domains: tuple[str, ...]) -> Column:
    h = F.regexp_replace(host(u), r":\d+$", "")
    ok = F.lit(False)
    for d in domains:
        ok = ok | (h == d) | h.endswith("." + d)
    return ok


def _usable(href: Column) -> Column:
    return (href != "") & ~href.startswith("#") & ~href.startswith("javascript:")


def hrefs(html_col) -> Column:
    """array<string> of the distinct addresses of the usable links, as written."""
    found = F.transform(F.regexp_extract_all(T._col(html_col), F.lit(LINK), F.lit(1)), lambda h: F.trim(h))
    return F.array_distinct(F.filter(found, _usable))


def links(html_col, base) -> Column:
    """array<struct<url, text>> of the usable links, in order, first of each pair.

    Distinct (url, text) pairs are kept in order; their position is `ordem`.
    """
    html_col, base = T._col(html_col), T._col(base)
    written = F.regexp_extract_all(html_col, F.lit(LINK), F.lit(1))
    bodies = F.regexp_extract_all(html_col, F.lit(LINK), F.lit(2))
    pairs = F.zip_with(written, bodies, lambda h, b: F.struct(F.trim(h).alias("h"), b.alias("b")))
    usable = F.filter(pairs, lambda p: _usable(p["h"]))
    return F.array_distinct(F.transform(usable, lambda p: F.struct(
        absolute(T.unescape(p["h"]), base).alias("url"), F.nullif(inline_text(p["b"]), F.lit("")).alias("text"))))


# --- sections -------------------------------------------------------------------


def is_pseudo_title(fragment: Column) -> Column:
    """A short paragraph wholly in bold, without a final full stop."""
    text = inline_text(fragment)
    bold = T.tidy(F.array_join(F.transform(
        F.regexp_extract_all(fragment, F.lit(r"(?is)<(?:strong|b)\b[^>]*>(.*?)</(?:strong|b)\s*>"), F.lit(1)),
        lambda x: strip_tags(x)), " "))
    def bare(x):
        return F.regexp_replace(x, r":+$", "")
    label = F.trim(bare(T.normalize(text)))
    return ((text != "") & (F.length(text) <= MAX_PSEUDO_TITLE) & ~text.endswith(".")
            & ~label.isin(*NOT_TITLES) & (bold != "") & (bare(bold) == bare(text)))


def sections(html_col) -> Column:
    """array<struct<title, level, anchor, text, html>> split at headings and bold titles.

    Headings h1-h6 and bold paragraphs open a section; an empty anchor element
    before a title, or an id on it, is carried to the title. Content before the
    first title forms a section without a title.
    """
    body = drop_elements(F.coalesce(T._col(html_col), F.lit("")), ("head",) + IGNORED)
    piece = r"(?is)(<h[1-6]\b[^>]*>.*?</h[1-6]\s*>|<p\b[^>]*>.*?</p\s*>)"
    marked = F.regexp_replace(body, piece, MARK + "$1" + MARK)
    parts = F.filter(F.split(marked, MARK), lambda x: F.trim(x) != "")

    def kind(x: Column) -> Column:
        heading = F.regexp_extract(x, r"(?is)^\s*<h([1-6])\b", 1)
        pseudo = x.rlike(r"(?is)^\s*<p\b") & is_pseudo_title(x)
        named = F.regexp_extract(x, r"""(?is)<a\b(?![^>]*\bhref)[^>]*\b(?:name|id)\s*=\s*["']([^"']+)""", 1)
        own = F.regexp_extract(x, r"""(?is)^\s*<(?:h[1-6]|p)\b[^>]*\bid\s*=\s*["']([^"']+)""", 1)
        level = F.when(heading != "", heading.try_cast("int")).when(pseudo, 4)
        title = F.when(level.isNotNull(), inline_text(x))
        title = F.when(pseudo & (heading == ""), F.regexp_replace(title, r":+$", "")).otherwise(title)
        anchor = F.coalesce(F.nullif(named, F.lit("")), F.nullif(own, F.lit("")))
        lone = level.isNull() & (named != "") & (inline_text(x) == "")
        return F.struct(F.nullif(title, F.lit("")).alias("title"), level.alias("level"), anchor.alias("anchor"),
                        lone.alias("lone"), x.alias("html"))

    empty = F.struct(F.lit(None).cast("string").alias("title"), F.lit(0).alias("level"),
                     F.lit(None).cast("string").alias("anchor"), F.lit("").alias("html"))
    start = F.struct(empty.alias("cur"), F.lit(None).cast("string").alias("pending"),
                     F.filter(F.array(empty), lambda x: F.lit(False)).alias("done"))

    def step(acc: Column, p: Column) -> Column:
        opened = F.struct(p["title"].alias("title"), p["level"].alias("level"),
                          F.coalesce(p["anchor"], acc["pending"]).alias("anchor"), F.lit("").alias("html"))
        grown = F.struct(acc["cur"]["title"].alias("title"), acc["cur"]["level"].alias("level"),
                         acc["cur"]["anchor"].alias("anchor"),
                         F.concat(acc["cur"]["html"], p["html"]).alias("html"))
        none = F.lit(None).cast("string")
        return (F.when(p["title"].isNotNull(), F.struct(
                    opened.alias("cur"), none.alias("pending"),
                    F.concat(acc["done"], F.array(acc["cur"])).alias("done")))
                .when(p["lone"], F.struct(acc["cur"].alias("cur"), p["anchor"].alias("pending"),
                                          acc["done"].alias("done")))
                .otherwise(F.struct(grown.alias("cur"), F.coalesce(p["anchor"], acc["pending"]).alias("pending"),
                                    acc["done"].alias("done"))))

    folded = F.aggregate(F.transform(parts, kind), start, step,
                         lambda acc: F.concat(acc["done"], F.array(acc["cur"])))
    full = F.transform(folded, lambda s: F.struct(
        s["title"].alias("title"), s["level"].alias("level"), s["anchor"].alias("anchor"),
        to_text(s["html"]).alias("text"), s["html"].alias("html")))
    return F.filter(full, lambda s: s["title"].isNotNull() | (s["text"] != ""))
