"""Context blocks and prompts built from ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values.
MAX_DOC_CHARS, MAX_RECORD_CHARS = 1500, 4000
SEPARATOR = "\n\n---\n\n"


def assemble(rows: DataFrame, *, title: Column, source: Column, content: Column, doc_key: str,
             record: Column, max_chars: int = MAX_DOC_CHARS, max_record: int = MAX_RECORD_CHARS) -> DataFrame:
    """(query_id, context): ranked blocks; a document's record is shown once.

    rows: query_id, rank (a short list per question) and the columns used.
    """
    first = F.row_number().over(Window.partitionBy("query_id", doc_key).orderBy("rank")) == 1
    header = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("[Título: "), title, F.lit(" | Fonte: "), source, F.lit("]"))).otherwise(
        F.concat(F.lit("[Fonte: "), F.coalesce(source, F.lit("documento")), F.lit("]")))
    body = T.truncate(content, max_chars, "…")
    full = T.truncate(record, max_record, "\n... (truncado)")
    blocks = rows.withColumn("lead", first & record.isNotNull()).withColumn("block", F.concat(
        header, F.lit("\n"), body,
        F.when(F.col("lead"), F.concat(F.lit("\n\n[Dados completos do documento]\n"), full)).otherwise(F.lit(""))))
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda s: s["block"]), SEPARATOR).alias("context"))


def subject_line(name, code=None, credits=None, hours=None, kind=None, url=None) -> Column:
    """'  - NAME (cód. C) | n créditos | nh | kind | url', omitting missing parts."""
    def part(c, fmt: str):
        if c is None:
            return F.lit("")
        s = F.coalesce(T._col(c).cast("string"), F.lit(""))
        return F.when(s != "", F.format_string(fmt, s)).otherwise(F.lit(""))

    return F.concat(F.lit("  - "), F.coalesce(T._col(name), F.lit("?")), part(code, " (cód. %s)"), part(credits, " | %s créditos"),
                    part(hours, " | %sh"), part(kind, " | %s"), part(url, " | %s"))


# Prompt texts are the caller's: one template per collection plus a default,
# with the placeholders {context}, {question}, {n_docs} and {instruction}.
DEFAULT_TEMPLATE = ("{instruction}\n\n## Contexto Recuperado:\n{context}\n\n## Pergunta:\n{question}\n\n## Resposta:")
DEFAULT_INSTRUCTION = ("Responda somente com base no contexto abaixo. Se a resposta não estiver nele, diga que não a encontrou "
                       "e não invente.")


def render(template: str, **values: Column) -> Column:
    """Fill a template's placeholders with columns."""
    import re
    parts = []
    for piece in re.split(r"(\{[a-z_]+\})", template):
        if re.fullmatch(r"\{[a-z_]+\}", piece):
            parts.append(F.coalesce(values[piece[1:-1]].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.trim(F.concat(*parts))


def prompt(df: DataFrame, templates: dict[str, str] | None = None, instruction: str = DEFAULT_INSTRUCTION) -> DataFrame:
    """Add `prompt` for rows with question, context, n_docs and collection."""
    values = {"context": F.col("context"), "question": F.col("question"), "n_docs": F.col("n_docs"), "instruction": F.lit(instruction)}
    chosen = None
    for name, template in (templates or {}).items():
        hit = F.col("collection") == name
        text = render(template, **values)
        chosen = F.when(hit, text) if chosen is None else chosen.when(hit, text)
    default = render(DEFAULT_TEMPLATE, **values)
    return df.withColumn("prompt", default if chosen is None else chosen.otherwise(default))


def join_chunks(chunks: Column) -> Column:
    return F.array_join(chunks, SEPARATOR)


def page_footer(remaining: Column) -> Column:
    """Closing line of a list page."""
    return F.when(remaining > 0, F.format_string("\n\n%d resultado(s) a mostrar; peça para continuar.", remaining)).otherwise(
        F.lit("\n\nFim da lista."))
