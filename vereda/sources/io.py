"""Readers and writers: JSON datasets, question files, reports, table loads."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .. import session
from ..functions import text as T
from ..operators import dedup

# Fixed value: the text a legacy record carries instead of a missing value.
EMPTY_TEXT = "Não há informações disponíveis"

QUESTION_SCHEMA = ("id STRING, pergunta STRING, resposta_esperada STRING, deve_conter ARRAY<STRING>, "
                   "deve_conter_algum ARRAY<STRING>, ferramentas_esperadas ARRAY<STRING>")
RECORD_SCHEMA = ("id STRING, tipo STRING, titulo STRING, embedding_text STRING, metadata MAP<STRING,STRING>, "
                 "dados_completos STRING, url STRING, title STRING, text STRING, crawled_at STRING")


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Crawled records of either layout, as doc_id, kind, title, text, url, metadata, record.

    `lines`: one record per line, which Spark can split; else one JSON array per file.

    The layout is told by the presence of `embedding_text`; the placeholder for
    missing values becomes NULL.
    """
    raw = spark.read.schema(RECORD_SCHEMA).option("multiLine", not lines).json(path)
    modern = F.col("embedding_text").isNotNull()
    url = F.coalesce(F.try_element_at("metadata", F.lit("url")), "url")
    out = raw.select(
        F.coalesce("id", F.sha2(F.coalesce(url, "text"), 256)).alias("doc_id"),
        F.coalesce("tipo", F.lit("portal_geral")).alias("kind"),
        F.when(modern, F.col("titulo")).otherwise(F.col("title")).alias("title"),
        F.when(modern, F.col("embedding_text")).otherwise(F.col("text")).alias("text"),
        url.alias("url"), "metadata", F.col("dados_completos").alias("record"))
    return out.withColumns({c: F.nullif(c, F.lit(EMPTY_TEXT)) for c in ("title", "text", "url")})


def read_tables(spark: SparkSession, path: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """A `{table: [row, ...]}` dataset: one frame per table.

    `schemas` maps table names to row DDL. A file that is not an object is refused.
    """
    whole = ", ".join(f"`{name}` ARRAY<STRUCT<{_as_struct(ddl)}>>" for name, ddl in schemas.items())
    raw = (spark.read.schema(f"{whole}, _corrupt STRING").option("multiLine", True)
           .option("columnNameOfCorruptRecord", "_corrupt").json(path))
    kind = spark.read.text(path, wholetext=True).select(F.left(F.ltrim(F.col("value")), F.lit(1)).alias("c"))
    if not kind.filter(F.col("c") != "{").isEmpty():
        raise ValueError(f"{path}: expected an object of tables")
    return {name: raw.select(F.explode(name).alias("r")).select("r.*") for name in schemas}


def _as_struct(ddl: str) -> str:
    schema = ST.StructType.fromDDL(ddl)
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in schema.fields)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question files: JSON lines with '#' comments, or a JSON array.

    A missing id becomes 'q<i>', i counting the questions of the file.
    """
    if path.endswith(".json"):
        raw = spark.read.schema(QUESTION_SCHEMA).option("multiLine", True).json(path)
        q = raw.withColumn("line", F.monotonically_increasing_id())
    else:
        lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
        kept = lines.filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
        q = kept.select(F.from_json("value", QUESTION_SCHEMA).alias("q"), "line").select("q.*", "line")
    # A gold set is a small hand-written file, so one ordered window is enough.
    w = Window.orderBy("line")
    return q.withColumn("id", F.coalesce("id", F.concat(F.lit("q"), F.row_number().over(w).cast("string")))).drop("line")


def read_pdf_pages(spark: SparkSession, path: str, parse=None) -> DataFrame:
    """One row per PDF page (source, page, text); needs a page parser.

    `parse(bytes) -> list[str]`; by default pypdf, when it is installed.
    """
    if parse is None:
        try:
            from pypdf import PdfReader
        except ImportError as exc:
            raise RuntimeError("reading PDF needs pypdf or a parse function") from exc

        def parse(content):
            import io
            return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]

    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [(p, i, t) for p, c in zip(pdf["path"], pdf["content"]) for i, t in enumerate(parse(bytes(c)))]
            yield pd.DataFrame(rows, columns=["source", "page", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "source string, page int, text string")


# --- ids and loads ------------------------------------------------------------------


def surrogate_ids(df: DataFrame, keys: list[str], out: str = "id") -> DataFrame:
    """Dense ids 1..n in key order, the same on every load.

    Rows are range-partitioned by key, numbered inside each range and shifted
    by the sizes of the ranges before it, so no task sees the whole table. The
    ranged rows are checkpointed first: both passes must see the same ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = session.checkpoint(df.repartitionByRange(n, *keys).withColumn("__b", F.spark_partition_id()))
    sizes = ranged.groupBy("__b").agg(F.count("*").alias("__n"))
    # One row per range: at most `n` rows.
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(
        Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    local = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(*keys)))
    return (local.join(F.broadcast(before), "__b").withColumn(out, F.col("__r") + F.col("__before"))
            .drop("__b", "__r", "__before"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition: str | None = None) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(partition) if partition else w).parquet(path)


def insert_ignore(spark: SparkSession, new: DataFrame, path: str, keys: list[str], seq: str | None = None) -> DataFrame:
    """Rows of `new` (first per key) whose key is not stored yet; appends them."""
    order = [F.col(seq)] if seq else [F.xxhash64(*new.columns)]
    fresh = dedup.keep_one(new, keys, order)
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)
    return fresh


def upsert_table(spark: SparkSession, new: DataFrame, path: str, keys: list[str], keep_old: list[str] = ()) -> str:
    """Upsert into a versioned table folder and return the new version's path.

    A version is written beside the old one and then named in `_current`, so a
    failed write never damages the table being read.
    """
    current = current_version(spark, path)
    merged = dedup.upsert(spark.read.parquet(current), new, keys, list(keep_old)) if current else new
    number = int(current.rsplit("v", 1)[1]) + 1 if current else 0
    target = f"{path}/v{number}"
    merged.write.mode("overwrite").parquet(target)
    spark.createDataFrame([(number,)], "version int").coalesce(1).write.mode("overwrite").json(f"{path}/_current")
    return target


def current_version(spark: SparkSession, path: str) -> str | None:
    if not _exists(spark, f"{path}/_current"):
        return None
    row = spark.read.schema("version int").json(f"{path}/_current").agg(F.max("version")).first()
    return None if row[0] is None else f"{path}/v{row[0]}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def reload_tables(tables: Mapping[str, DataFrame], root: str, keys: Mapping[str, list[str]]) -> dict[str, str]:
    """Idempotent refresh: each table is de-duplicated by key and rewritten whole."""
    out = {}
    for name, df in tables.items():
        rows = dedup.keep_one(df, keys[name], [F.xxhash64(*df.columns)]) if name in keys else df
        out[name] = os.path.join(root, name)
        rows.write.mode("overwrite").parquet(out[name])
    return out


def capped_by_type(docs: DataFrame, cap: int | None, kind: str = "kind", order: str = "doc_id") -> DataFrame:
    """At most `cap` documents per type, in `order`; the whole input without a cap."""
    if cap is None:
        return docs
    w = Window.partitionBy(kind).orderBy(order)
    return docs.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= cap).drop("__r")


def ingest(docs: DataFrame, root: str, chunker, embedder, cap: int | None = None) -> DataFrame:
    """Segmented ingest: cap per type, chunk, embed once, write both layouts.

    The chunks are written first; the collection layout reads them back, so the
    embeddings are computed once whatever happens to executors in between.
    """
    from ..functions import rules as R
    spark = docs.sparkSession
    chunks = chunker(capped_by_type(docs, cap)).withColumn("id", F.concat_ws("#", "doc_id", F.col("chunk_ix").cast("string")))
    vecs = embedder(chunks)
    full = chunks.join(vecs, "id", "left").join(docs.select("doc_id", "kind", "title"), "doc_id")
    full.write.mode("overwrite").partitionBy("kind").parquet(f"{root}/typed")
    stored = spark.read.parquet(f"{root}/typed")
    (stored.withColumn("collection", R.collection_of_type("kind")).write.mode("overwrite")
     .partitionBy("collection").parquet(f"{root}/collections"))
    return stored


def collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Chunks of one collection; only its partition is read."""
    return spark.read.parquet(f"{root}/collections").filter(F.col("collection") == name)


# --- reports ------------------------------------------------------------------------------


def metadata_table(spark: SparkSession, values: Mapping[str, object]) -> DataFrame:
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in values.items()], "key string, value string")


def dry_run_report(facets: DataFrame) -> DataFrame:
    """Texts per facet family with count, mean length and one sample."""
    family = F.regexp_replace("scope", r"#\d+$", "")
    return facets.groupBy(family.alias("family")).agg(
        F.count("*").alias("texts"), F.round(F.avg(F.length("text")), 1).alias("mean_chars"),
        F.min(F.left("text", F.lit(120))).alias("sample"))


def markdown(df: DataFrame, limit: int = 200) -> str:
    """The first rows of a result as a Markdown table; a last line tells if there are more."""
    rows = df.limit(limit + 1).collect()
    more, rows = len(rows) > limit, rows[:limit]
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("\n", " ").replace("|", "\\|") for v in r) + " |" for r in rows]
    return "\n".join([*lines, f"\n(only the first {limit} rows)"] if more else lines)


def null_placeholders(df: DataFrame) -> DataFrame:
    """Replace the legacy placeholder by NULL in every string column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, ST.StringType)]
    return df.withColumns({c: F.nullif(T._col(c), F.lit(EMPTY_TEXT)) for c in names})
