"""Readers and writers, each over tables written to a run folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import session
from ..functions import embed
from ..operators import chunk as C
from ..sources import io
from .registry import query
from .textual import CHAR_WINDOW_SQL


@query("io_documents", """
SELECT 'd' || doc_id AS doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'portal_geral' END AS kind,
 CASE WHEN doc_id % 5 <> 0 THEN source END AS title, text, 'http://example.org/' || doc_id AS url FROM documents""")
def io_documents(t):
    """Both record layouts; the placeholder becomes NULL."""
    path = session.run_folder(t.spark, "io-documents")
    even, url = F.col("doc_id") % 2 == 0, F.concat(F.lit("http://example.org/"), F.col("doc_id").cast("string"))
    title = F.when(F.col("doc_id") % 5 == 0, io.EMPTY_TEXT).otherwise(F.col("source"))
    t.documents.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.when(even, F.col("lang")).alias("tipo"),
        F.when(even, title).alias("titulo"), F.when(even, F.col("text")).alias("embedding_text"),
        F.when(even, F.create_map(F.lit("url"), url)).alias("metadata"), F.when(~even, url).alias("url"),
        F.when(~even, title).alias("title"), F.when(~even, F.col("text")).alias("text")).write.json(path)
    return io.read_documents(t.spark, path, lines=True).select("doc_id", "kind", "title", "text", "url")


@query("io_insert_ignore", "SELECT o_orderkey, o_orderstatus FROM orders")
def io_insert_ignore(t):
    """Loading a part, then everything twice over, stores each key once."""
    path = session.run_folder(t.spark, "io-insert")
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    io.insert_ignore(t.spark, rows.filter("o_orderkey % 3 = 0"), path, ["o_orderkey"])
    io.insert_ignore(t.spark, rows.union(rows), path, ["o_orderkey"])
    return t.spark.read.schema(rows.schema).parquet(path)


@query("io_upsert_table", """
SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def io_upsert_table(t):
    """A second version replaces the segment and keeps the balance that is known."""
    path = session.run_folder(t.spark, "io-upsert")
    rows = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    io.upsert_table(t.spark, rows, path, ["c_custkey"])
    later = rows.filter("c_custkey % 2 = 0").withColumn("c_acctbal", F.lit(None).cast("double")).withColumn("c_mktsegment", F.lit("NEW"))
    io.upsert_table(t.spark, later, path, ["c_custkey"], keep_old=["c_acctbal"])
    return t.spark.read.parquet(io.current_version(t.spark, path)).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("io_reload_tables", """
SELECT 'nation' AS "table", count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FROM orders""")
def io_reload_tables(t):
    path = session.run_folder(t.spark, "io-reload")
    tables, keys = {"nation": t.nation, "orders": t.orders.union(t.orders)}, {"orders": ["o_orderkey"]}
    io.reload_tables(tables, path, keys)
    found = io.reload_tables(tables, path, keys)
    counts = [t.spark.read.parquet(p).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, p in found.items()]
    return counts[0].unionByName(counts[1])


@query("io_ingest", f"""{CHAR_WINDOW_SQL}
SELECT CASE doc_id % 3 WHEN 0 THEN 'ufpel_disciplinas' WHEN 1 THEN 'ufpel_projetos' ELSE 'ufpel_servidores' END AS collection,
 count(*) AS chunks, sum(length(piece)) AS chars, count(*) AS embedded FROM pieces GROUP BY 1""")
def io_ingest(t):
    """Chunks of every document with their vectors, laid out by collection."""
    path = session.run_folder(t.spark, "io-ingest")
    kind = F.element_at(F.array(F.lit("disciplina"), F.lit("projeto"), F.lit("servidor")), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = t.documents.select("doc_id", kind.alias("kind"), F.col("source").alias("title"), "text")

    def chunker(df):
        return df.select("doc_id", F.posexplode(C.char_windows("text")).alias("chunk_ix", "chunk"))

    io.ingest(docs, path, chunker, lambda chunks: embed.embed(chunks, "chunk"))
    names = ("ufpel_disciplinas", "ufpel_projetos", "ufpel_servidores")
    parts = [io.collection(t.spark, path, n).groupBy("collection").agg(
        F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"), F.count("embedding").alias("embedded")) for n in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("io_null_placeholders", """
SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders""")
def io_null_placeholders(t):
    told = F.when(F.col("o_orderpriority") == "5-LOW", io.EMPTY_TEXT).otherwise(F.col("o_orderpriority"))
    return io.null_placeholders(t.orders.select("o_orderkey", told.alias("priority")))


@query("io_dry_run_report", f"""{CHAR_WINDOW_SQL},
f AS (SELECT source, 'Documento' || CASE WHEN n > 1 THEN ' (parte ' || (pos + 1) || '/' || n || ')' ELSE '' END || chr(10) || piece AS text
 FROM pieces JOIN documents USING (doc_id) WHERE length(t) >= {C.MIN_FACET})
SELECT source AS family, count(*) AS texts, round(avg(length(text)), 1) AS mean_chars, min(left(text, 120)) AS sample FROM f GROUP BY 1""")
def io_dry_run_report(t):
    return io.dry_run_report(C.facets(t.documents, "doc_id", scope=F.col("source"), title=F.lit("Documento"), text=F.col("text")))
