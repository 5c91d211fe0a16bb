"""Chunking: text to ordered pieces, as array expressions.

Only the recursive splitter runs Python (a small function per text); the
others are folds over arrays inside the JVM.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import let

# Fixed values.
SIZE, OVERLAP, SECTION_OVERLAP = 500, 50, 20
FACET_SIZE, FACET_OVERLAP = 2000, 200
MIN_FACET, MIN_PORTAL_FACET = 25, 40
WHOLE_WARNING = 2000
SWEEP = ((200, 20), (500, 50), (800, 80))
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
SECTION_HEADERS = (
    "Tipo:", "Nome do Projeto:", "Nome da Atividade:", "Nome do Servidor:", "Nome da Unidade:",
    "Nome do Curso:", "Resumo:", "Objetivo Geral:", "Objetivos:", "Justificativa:", "Metodologia:",
    "Ementa:", "Conteúdo Programático:", "Equipe:", "Membros da Equipe:", "Coordenador:",
    "Coordenador Atual:", "Docentes:", "Servidores:", "Currículo Lattes:", "Formação acadêmica:",
    "Áreas de atuação:", "Titulação:", "Cargo:", "Unidade:", "Departamento:", "Carga Horária:",
    "Créditos:", "Ênfase:", "Área CNPq:", "Linha de Extensão:", "Eixo Temático:",
    "Data inicial - Data final:")


# --- word windows -----------------------------------------------------------------


def word_windows(c, size: int = 150, overlap: int = 30, tail: str = "reference") -> Column:
    """Windows of `size` words sharing `overlap` words.

    tail='reference' keeps the shrinking pieces after the end has been reached;
    tail='clean' stops at the first window that reaches the end.
    """
    step = max(size - overlap, 1)

    def build(ws: Column) -> Column:
        n = F.size(ws)
        last = (F.ceil(F.greatest(n - size, F.lit(0)) / F.lit(step)) * step).cast("int")
        starts = F.sequence(F.lit(0), last, F.lit(step))
        if tail == "reference":
            after = F.greatest(n - overlap, last + 1)
            starts = F.when(after < n, F.concat(starts, F.sequence(after, F.greatest(n - 1, after)))).otherwise(starts)
        pieces = F.transform(starts, lambda s: F.array_join(F.slice(ws, s + 1, F.lit(size)), " "))
        return F.when(n > 0, pieces).otherwise(F.array().cast("array<string>"))

    return let(T.words(c), build)


# --- character windows cut at natural boundaries -----------------------------------


def char_windows(c, size: int = FACET_SIZE, overlap: int = FACET_OVERLAP) -> Column:
    """Windows of at most `size` characters, cut after the last blank or newline
    when that lies past the middle of the window."""
    advance = max(1, size // 2 + 1 - overlap)

    def build(t: Column) -> Column:
        n = F.length(t)
        steps = F.sequence(F.lit(1), F.ceil(n / F.lit(advance)).cast("int") + 1)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"), F.lit(False).alias("done"))

        def step(acc: Column, _: Column) -> Column:
            stop = F.least(acc["at"] + size, n)
            window = F.substr(t, acc["at"] + 1, stop - acc["at"])
            blank = F.greatest(T.last_index(window, "\n"), T.last_index(window, " "))
            end = let(blank, lambda b: F.when((stop < n) & (b > size * 0.5), acc["at"] + b.cast("int") + 1).otherwise(stop))

            def close(e: Column) -> Column:
                piece = T.strip(F.substr(t, acc["at"] + 1, e - acc["at"]))
                return F.struct(
                    F.greatest(e - overlap, acc["at"] + 1).alias("at"),
                    F.when(piece != "", F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"),
                    (e >= n).alias("done"))

            return F.when(acc["done"], acc).otherwise(let(end, close))

        cut = F.aggregate(steps, start, step, lambda acc: acc["out"])
        return (F.when(t == "", F.array().cast("array<string>"))
                .when(n <= size, F.array(t)).otherwise(cut))

    return let(T.strip(F.coalesce(T._col(c), F.lit(""))), build)


# --- recursive splitter --------------------------------------------------------------


def _cut(text: str, sep: str) -> list[str]:
    """Pieces that concatenate to `text`; each but the first begins with `sep`."""
    if not sep:
        return list(text)
    head, *rest = text.split(sep)
    return [p for p in [head, *(sep + r for r in rest)] if p]


def _pack(pieces, size: int, overlap: int):
    """Join consecutive pieces up to `size`, keeping up to `overlap` for the next."""
    window: deque[str] = deque()
    held = 0
    for piece in pieces:
        if window and held + len(piece) > size:
            yield "".join(window)
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    if window:
        yield "".join(window)


def split_recursive(text: str, size: int = SIZE, overlap: int = OVERLAP, separators=SEPARATORS) -> list[str]:
    """Split at the coarsest separator present, going finer only for long pieces."""
    level = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    finer = separators[level + 1:]
    out, short = [], []

    def flush():
        out.extend(_pack(short, size, overlap))
        short.clear()

    for piece in _cut(text, separators[level]):
        if len(piece) < size:
            short.append(piece)
            continue
        flush()
        if finer:
            out.extend(split_recursive(piece, size, overlap, finer))
        else:
            out.append(piece)
    flush()
    return [p for p in (x.strip() for x in out) if p]


# Characters of pieces that stay Python strings before they become an Arrow array; it bounds memory, not results.
HELD_CHARS = 1 << 22


def _split_all(texts: pa.Array, size: int, overlap: int) -> pa.Array:
    """The pieces of each text, one text at a time."""
    done, lists, held = [], [], 0
    for t in texts:
        t = t.as_py()
        lists.append(None if t is None else split_recursive(t, size, overlap))
        held += len(t or "")
        if held >= HELD_CHARS:
            done.append(pa.array(lists, pa.list_(pa.string())))
            lists, held = [], 0
    return pa.concat_arrays([*done, pa.array(lists, pa.list_(pa.string()))])


def recursive(c, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return _split_all(texts, size, overlap)

    return run(T._col(c))


def sweep(df: DataFrame, text: str, settings=SWEEP) -> DataFrame:
    """Chunk counts of each (size, overlap) setting, one pass per text."""
    per = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(o).alias("overlap"),
                             recursive(text, s, o).alias("chunks")) for s, o in settings])
    return (df.select(F.explode(per).alias("p"))
            .groupBy(F.col("p.size").alias("size"), F.col("p.overlap").alias("overlap"))
            .agg(F.sum(F.size("p.chunks")).alias("chunks"),
                 F.max(F.array_max(F.transform("p.chunks", lambda x: F.length(x)))).alias("longest")))


# --- section-aware splitter ------------------------------------------------------------


def _header_pattern() -> str:
    import re
    return "|".join(re.escape(h).replace(r"\ ", " ").replace(r"\-", "-")
                    for h in sorted(SECTION_HEADERS, key=len, reverse=True))


def sections(c) -> Column:
    """Sections 'header content', from lines starting with a known header and a blank."""
    marked = F.regexp_replace(T._col(c), rf"(?dm)^((?:{_header_pattern()})[^\S\n])", "\u0001$1")
    parts = F.slice(F.split(marked, "\u0001"), F.lit(2), F.size(F.split(marked, "\u0001")))

    def one(s: Column) -> Column:
        header = F.regexp_extract(s, rf"^({_header_pattern()})", 1)
        rest = F.substr(s, F.length(header) + 1)
        first = T.strip(F.split_part(rest, F.lit("\n"), F.lit(1)))
        at = F.instr(rest, "\n")
        body = F.when(at > 0, T.strip(F.concat(first, F.substr(rest, at)))).otherwise(first)
        return T.strip(F.concat(header, F.lit(" "), body))

    return F.transform(parts, one)


def merge_sections(parts: Column, size: int = SIZE) -> Column:
    """Join neighbouring sections while their summed length stays within `size`."""
    start = F.struct(F.array().cast("array<string>").alias("cur"), F.lit(0).alias("held"),
                     F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fits = (F.size(acc["cur"]) == 0) | (acc["held"] + F.length(s) <= size)
        return (F.when(fits, F.struct(F.concat(acc["cur"], F.array(s)).alias("cur"),
                                      (acc["held"] + F.length(s)).alias("held"), acc["out"].alias("out")))
                .otherwise(F.struct(F.array(s).alias("cur"), F.length(s).alias("held"),
                                    F.concat(acc["out"], F.array(F.array_join(acc["cur"], "\n\n"))).alias("out"))))

    return F.aggregate(parts, start, step, lambda acc: F.when(F.size(acc["cur"]) == 0, acc["out"]).otherwise(
        F.concat(acc["out"], F.array(F.array_join(acc["cur"], "\n\n")))))


def overlap_prefix(chunks: Column, overlap: int = SECTION_OVERLAP) -> Column:
    """Prefix each later chunk with the word-aligned end of the one before it."""
    def tail_of(prev: Column) -> Column:
        tail = F.right(prev, F.lit(overlap))
        space = F.instr(tail, " ")
        aligned = F.when((space > 0) & (space < F.length(tail)), F.substr(tail, space + 1)).otherwise(tail)
        return T.strip(aligned)

    def prefixed(cs: Column) -> Column:
        def one(cur: Column, i: Column) -> Column:
            return let(tail_of(F.get(cs, i - 1)), lambda tail: F.when((i == 0) | (tail == ""), cur).otherwise(
                F.concat(tail, F.lit("\n"), cur)))

        return F.transform(cs, one)

    return let(chunks, prefixed)


def section_chunks(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP,
                   section_overlap: int = SECTION_OVERLAP) -> DataFrame:
    """(key, chunk_ix, chunk, section_headers, structured); two sections or more
    are merged and overlapped, other texts go to the recursive splitter."""
    s = df.withColumn("__s", sections(text))
    structured = F.size("__s") > 1
    s = s.withColumn("__plain", recursive(F.when(~structured, F.col(text)), size, overlap))
    merged = overlap_prefix(merge_sections(F.col("__s"), size), section_overlap)
    out = s.select(key, structured.alias("structured"),
                   F.posexplode(F.when(structured, merged).otherwise(F.col("__plain"))).alias("chunk_ix", "chunk"))
    found = F.regexp_extract_all("chunk", F.lit(rf"(?dm)^((?:{_header_pattern()}))[^\S\n]"), F.lit(1))
    return out.withColumn("section_headers", F.when(F.col("structured"), F.transform(
        found, lambda h: F.regexp_replace(h, ":$", ""))))


# --- facets ---------------------------------------------------------------------------


def facets(df: DataFrame, key: str, *, scope: Column, title: Column, text: Column,
           url: Column | None = None, min_chars: int = MIN_FACET, metadata: Column | None = None) -> DataFrame:
    """Facet rows: title repeated on each piece; scopes 's', 's#2', 's#3'...

    metadata, a map of texts, is kept on each piece with its number and the number of pieces.
    """
    carried = [] if metadata is None else [metadata.alias("metadata")]
    pieces = df.select(F.col(key).alias("key"), scope.alias("scope"), title.alias("title"),
                       (url if url is not None else F.lit(None).cast("string")).alias("url"), *carried,
                       F.when(F.length(T.strip(text)) >= min_chars, char_windows(text)).alias("pieces"))
    rows = pieces.filter(F.col("pieces").isNotNull()).withColumn("n", F.size("pieces")).select(
        "key", "scope", "title", "url", "n", *_named(carried), F.posexplode("pieces").alias("pos", "piece"))
    place = F.create_map(F.lit("chunk"), (F.col("pos") + 1).cast("string"), F.lit("chunks"), F.col("n").cast("string"))
    head = F.when(F.col("n") > 1, F.format_string("%s (parte %d/%d)", "title", F.col("pos") + 1, "n")).otherwise(F.col("title"))
    numbered = F.when(F.col("pos") == 0, F.col("scope")).otherwise(
        F.concat("scope", F.lit("#"), (F.col("pos") + 1).cast("string")))
    return rows.select("key", numbered.alias("scope"), "title", "url",
                       F.concat(head, F.lit("\n"), "piece").alias("text"),
                       (F.col("pos") + 1).alias("chunk"), F.col("n").alias("chunks"),
                       *[F.map_concat(m, place).alias(m) for m in _named(carried)])


def _named(carried: list) -> list[str]:
    return ["metadata"] if carried else []


def portal_facets(df: DataFrame, key: str, *, scope: Column, title: Column, text: Column,
                  url: Column | None = None, min_chars: int = MIN_PORTAL_FACET, metadata: Column | None = None) -> DataFrame:
    """Facet rows: the text's own header is repeated; scopes 's' or 's#0', 's#1'...

    metadata, a map of texts, is kept on each piece, with its number if there are several.
    """
    carried = [] if metadata is None else [metadata.alias("metadata")]

    def pieces(whole: Column) -> Column:
        head = F.left(F.split_part(whole, F.lit("\n\n"), F.lit(1)), F.lit(400))
        cut = let(char_windows(whole), lambda p: F.transform(p, lambda x, i: F.struct(
            i.alias("pos"), F.size(p).alias("n"), x.alias("piece"), F.when(i > 0, head).alias("head"))))
        return F.when(F.length(whole) >= min_chars, cut)

    # The text is made and cut in one expression: filters on its pieces, or an inner explode's own test, would repeat it.
    rows = df.select(F.col(key).alias("key"), scope.alias("scope"), title.alias("title"),
                     (url if url is not None else F.lit(None).cast("string")).alias("url"), *carried,
                     F.explode_outer(let(T.strip(F.coalesce(text, F.lit(""))), pieces)).alias("p"))
    rows = rows.filter(F.col("p").isNotNull()).select("key", "scope", "title", "url", *_named(carried), "p.*")
    place = F.create_map(F.lit("chunk"), F.col("pos").cast("string"))
    body = F.when(F.col("pos") == 0, F.col("piece")).otherwise(
        F.format_string("%s\n(continuação %d)\n%s", "head", F.col("pos") + 1, "piece"))
    numbered = F.when(F.col("n") == 1, F.col("scope")).otherwise(
        F.concat("scope", F.lit("#"), F.col("pos").cast("string")))
    return rows.select("key", numbered.alias("scope"), "title", "url", body.alias("text"),
                       F.col("pos").alias("chunk"), F.col("n").alias("chunks"),
                       *[F.when(F.col("n") > 1, F.map_concat(m, place)).otherwise(F.col(m)).alias(m) for m in _named(carried)])


def scope_family(scope) -> Column:
    return F.split_part(T._col(scope), F.lit("#"), F.lit(1))


# Strategy names used by the ingest: each maps a text column to its pieces.
STRATEGIES = {
    "documento": lambda c: F.array(T._col(c)),
    "recursivo": recursive,
}


def chunk(df: DataFrame, key: str, text: str, strategy: str = "recursivo") -> DataFrame:
    """(key, chunk_ix, chunk, oversize) under a named strategy."""
    if strategy == "semantico":
        out = section_chunks(df, key, text).select(key, "chunk_ix", "chunk")
    elif strategy in STRATEGIES:
        out = df.select(key, F.posexplode(STRATEGIES[strategy](text)).alias("chunk_ix", "chunk"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return out.withColumn("oversize", F.length("chunk") > WHOLE_WARNING)
