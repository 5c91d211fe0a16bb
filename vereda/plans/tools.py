"""The tools an agent or a person calls, as functions from frames to frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T

# Caps of a tool's printed result.
MAX_TOOL_CHARS, MAX_CELL, MAX_ROWS = 4500, 300, 40
PAGE_NOISE = ("script", "style", "nav", "footer", "header", "noscript")


def read_pages(pages: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    """Readable text of pages on the allowed hosts, capped for display."""
    return pages.filter(H.allowed_host(F.col("url"), domains)).withColumn(
        "text", T.truncate(H.to_text("html", PAGE_NOISE), MAX_TOOL_CHARS))


# --- SQL tool ---------------------------------------------------------------------


def run_sql(spark, statement: str) -> tuple[DataFrame | None, str | None]:
    """(rows, None) for one read-only statement, else (None, what was wrong).

    The result is limited to MAX_ROWS. An unknown column is answered with the
    most similar names of the tables the statement reads.
    """
    import re

    from pyspark.errors import AnalysisException, ParseException

    from ..functions import rules as R
    checked = spark.createDataFrame([(statement,)], "s string").select(
        R.guard_sql("s").alias("reason"), F.trim(F.regexp_replace("s", r";\s*$", "")).alias("s")).first()
    if checked["reason"]:
        return None, checked["reason"]
    try:
        return spark.sql(checked["s"]).limit(MAX_ROWS), None
    except ParseException as exc:
        return None, str(exc).splitlines()[0]
    except AnalysisException as exc:
        hint = ""
        found = re.search(r"name `?([\w.`]+?)`? cannot be resolved", str(exc))
        if found:
            tables = [t.lower() for t in re.findall(r"\b(?:from|join)\s+([A-Za-z_]\w*)", checked["s"], re.I)]
            names = suggest_columns(spark, found.group(1).replace("`", "").split(".")[-1], tables)
            hint = " | " + ", ".join(names) if names else ""
        return None, str(exc).splitlines()[0] + hint


def suggest_columns(spark, column: str, tables: list[str], k: int = 4, above: float = 0.3) -> list[str]:
    """Existing columns most similar to a wrong name."""
    known = [(t, c.name) for t in sorted(set(tables)) if spark.catalog.tableExists(t) for c in spark.catalog.listColumns(t)]
    if not known:
        return []
    sim = T.jaccard(T.word_trigrams("c"), T.word_trigrams(F.lit(column)))
    rows = (spark.createDataFrame(known, "t string, c string").withColumn("sim", sim).filter(F.col("sim") > above)
            .orderBy(F.col("sim").desc(), "t", "c").limit(k).collect())
    return [f"{r['t']}.{r['c']}" for r in rows]


def describe(spark, name: str) -> DataFrame:
    """(column, type, rows) of a table or view; similar names when it is unknown."""
    import re
    name = re.sub(r"[^a-z0-9_]", "", (name or "").lower())
    if spark.catalog.tableExists(name):
        rows = spark.table(name).count()
        return spark.createDataFrame([(c.name, c.dataType, rows) for c in spark.catalog.listColumns(name)],
                                     "column string, type string, rows long")
    similar = sorted(t.name for t in spark.catalog.listTables() if name[:12] in t.name)[:15]
    return spark.createDataFrame([(s, "similar", None) for s in similar], "column string, type string, rows long")


def view_lookup(spark, view: str, filters: dict[str, str], limit: int = 20) -> DataFrame:
    """`view(col=value)` as a case-insensitive substring filter over its columns."""
    df = spark.table(view)
    cols = {c.lower(): c for c in df.columns}
    for name, value in filters.items():
        if name.lower() in cols:
            df = df.filter(F.contains(F.lower(F.col(cols[name.lower()]).cast("string")), F.lit(str(value).lower())))
    return df.limit(limit)


def format_rows(df: DataFrame, max_cell: int = MAX_CELL, max_chars: int = MAX_TOOL_CHARS) -> str:
    """A tool result as text: 'a | b' lines, cells and total cut."""
    rows = df.limit(MAX_ROWS).collect()
    if not rows:
        return "0 linhas."

    def cut(v, n):
        s = "" if v is None else str(v)
        return s if len(s) <= n else s[:n] + " [...]"

    lines = [" | ".join(df.columns)] + [" | ".join(cut(v, max_cell) for v in r) for r in rows]
    return cut(f"{len(rows)} linha(s):\n" + "\n".join(lines), max_chars)


# --- semantic tool -----------------------------------------------------------------

# Sources of facets and the corpus of each.
SOURCES = {
    "curso": "institucional", "disciplina": "institucional", "servidor": "institucional",
    "projeto": "institucional", "turma": "institucional", "portal_noticia": "portal",
    "portal_pagina": "portal", "portal_faq": "portal", "ppgc_pagina": "ppgc", "ppgc_noticia": "ppgc",
    "ppgc_edital": "ppgc", "ppgc_normativo": "ppgc", "ppgc_faq": "ppgc", "ppgc_linha": "ppgc",
    "ppgc_disciplina": "ppgc", "ppgc_documento": "ppgc"}
SHOWN_METADATA = ("vinculo_ativo", "vigente", "nivel", "tipo", "ano", "cursos", "data_publicacao", "acervo")


def resolve_sources(name: str) -> list[str]:
    """Sources named by a corpus, a source, a facet table, or '' for all."""
    f = (name or "").strip().lower()
    if f in ("", "todas"):
        return list(SOURCES)
    if f in SOURCES.values():
        return [s for s, corpus in SOURCES.items() if corpus == f]
    return [s for s in SOURCES if f in (s, f"emb_{s}")]


def semantic_search(facets: DataFrame, questions: DataFrame, source: str = "", top_k: int = 6) -> DataFrame:
    """Best facets of the chosen sources: per source, then overall.

    facets: id, source, key, scope, title, url, text, metadata (map), embedding.
    """
    from ..operators import nearest
    k = max(1, min(int(top_k), 12))
    chosen = facets.filter(F.col("source").isin(resolve_sources(source)))
    found = nearest.branch_then_global(chosen, questions, k, "source")
    meta = F.map_filter("metadata", lambda key, _: key.isin(*SHOWN_METADATA))
    rows = chosen.select("id", "source", "key", "scope", "title", "url", meta.alias("metadata"),
                         T.truncate(F.replace("text", F.lit("\n"), F.lit(" ")), 600).alias("text"))
    return found.select("query_id", "id", "score", "rank").join(rows, "id")


# --- name tool ----------------------------------------------------------------------

# Table, key, name and address columns of the entities found by name.
NAMES = {
    "curso": ("curso", "codigo_ufpel", "nome", "url"), "disciplina": ("disciplina", "codigo", "nome", "url"),
    "servidor": ("servidor", "servidor_id", "nome", "url"), "projeto": ("projeto", "projeto_id", "titulo", "url"),
    "ppgc_edital": ("ppgc_edital", "edital_id", "titulo", "url"), "ppgc_normativo": ("ppgc_normativo", "normativo_id", "titulo", "url_pagina"),
    "ppgc_linha": ("ppgc_linha_pesquisa", "slug", "nome", "url"), "ppgc_disciplina": ("ppgc_disciplina", "disciplina_id", "nome", "url"),
    "portal_noticia": ("port_post", "post_id", "titulo", "url"), "ppgc_noticia": ("ppgc_post", "post_id", "titulo", "url"),
    "portal_pagina": ("port_pagina", "pagina_id", "titulo", "url"), "ppgc_pagina": ("ppgc_pagina", "pagina_id", "titulo", "url"),
    "grupo_pesquisa": ("port_grupo_pesquisa", "grupo_id", "nome", "url")}
NAME_SIMILARITY = 0.15


def resolve_entities(name: str) -> list[str]:
    """Entities named by a corpus, an entity, or '' for all; none if it is unknown."""
    e = (name or "").strip().lower()
    if e in NAMES:
        return [e]
    portal = [n for n in NAMES if n.startswith("portal_") or n == "grupo_pesquisa"]
    programme = [n for n in NAMES if n.startswith("ppgc_")]
    return {"": list(NAMES), "todas": list(NAMES), "portal": portal, "ppgc": programme,
            "institucional": [n for n in NAMES if n not in portal + programme]}.get(e, [])


def name_catalog(tables, entities: list[str]) -> DataFrame:
    """(entity, key, text, url) of the named entities whose tables exist; rows without a name are left out."""
    parts = []
    for entity in entities:
        table, key, name, url = NAMES[entity]
        try:
            df = tables[table]
        except KeyError:
            continue
        address = F.col(url) if url in df.columns else F.lit(None).cast("string")
        parts.append(df.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("key"), F.col(name).alias("text"), address.alias("url")))
    return reduce(DataFrame.unionByName, parts).filter("text IS NOT NULL")


def find_names(tables, questions: DataFrame, entity: str = "", top_k: int = 6) -> DataFrame:
    """Entities of similar name, or a name that holds the question: question, entity, key, name, url, sim, rank.

    questions: distinct `text`. Names are compared once each; rows that share one are dealt its rank by key, and no more than
    top_k of them can be among the best. An unknown entity gives an error.
    """
    from ..operators import setjoin
    k, chosen = max(1, min(int(top_k), 12)), resolve_entities(entity)
    if not chosen:
        raise ValueError(f"unknown entity {entity!r}")
    catalog = name_catalog(tables, chosen)
    found = setjoin.entity_lookup(questions, catalog.select("text", "entity").distinct(), NAME_SIMILARITY, k).drop("rank")
    few = catalog.withColumn("n", F.row_number().over(Window.partitionBy("entity", "text").orderBy("key"))).filter(F.col("n") <= k).drop("n")
    rows = found.join(few.withColumnRenamed("text", "name"), ["entity", "name"])
    best = Window.partitionBy("question").orderBy(F.col("sim").desc(), "entity", "name", "key")
    return (rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("question", "entity", "key", "name", "url", "sim", "rank"))


TOOLS = {f.__name__: f for f in (read_pages, run_sql, describe, view_lookup, semantic_search, find_names)}


def tool_schema(fn) -> dict:
    """Name, description and parameters of a tool, from its signature."""
    import inspect
    kinds = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "dict[str, str]": "object"}
    params = {n: {"type": kinds.get(str(p.annotation), "object")} for n, p in inspect.signature(fn).parameters.items()}
    need = [n for n, p in inspect.signature(fn).parameters.items() if p.default is inspect.Parameter.empty]
    return {"name": fn.__name__, "description": inspect.getdoc(fn) or "",
            "parameters": {"type": "object", "properties": params, "required": need}}
