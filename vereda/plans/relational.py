"""View-shaped joins, aggregations, set operations, dedup and integrity.

The star schema stands in for the entity tables: lineitem is the bridge.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, relate, scan
from .registry import query

# --- views --------------------------------------------------------------------


@query("view_entity_arrays", """
SELECT s.s_suppkey, s.s_name, list_sort(coalesce(list(DISTINCT p.p_brand) FILTER (p.p_brand IS NOT NULL), [])) AS brands,
 list_sort(coalesce(list(DISTINCT l.l_returnflag) FILTER (l.l_returnflag <> 'N'), [])) AS flags
FROM supplier s LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p.p_size > 40
GROUP BY 1, 2""")
def view_entity_arrays(t):
    lines = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey", "l_returnflag")
    big = t.part.filter(F.col("p_size") > 40).select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return relate.distinct_arrays(t.supplier.select("s_suppkey", "s_name"), "s_suppkey", {
        "brands": (lines.join(big, "l_partkey"), "p_brand"),
        "flags": (lines.withColumn("f", F.nullif("l_returnflag", F.lit("N"))), "f")})


@query("view_ordered_string_agg", """
WITH f AS (SELECT l_orderkey, l_returnflag || '/' || l_linestatus AS lab, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, string_agg(lab, ', ' ORDER BY o, lab) AS schedule FROM f GROUP BY 1""")
def view_ordered_string_agg(t):
    return relate.ordered_text(t.lineitem, ["l_orderkey"], F.concat_ws("/", "l_returnflag", "l_linestatus"),
                               F.col("l_linenumber"), "schedule")


@query("view_scalar_subquery", """
SELECT l.l_orderkey, l.l_linenumber, coalesce(CASE WHEN p.p_size > 25 THEN p.p_size END, l.l_quantity::INT) AS credits,
 (SELECT s_name FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_acctbal > 0) AS syllabus,
 (SELECT n_name FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE s.s_suppkey = l.l_suppkey) AS goals
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey""")
def view_scalar_subquery(t):
    sup = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("syllabus"),
        F.col("n_name").alias("goals"))
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"))
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"))
    return (t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
            .join(orders, "l_orderkey").join(part, "l_partkey").join(sup, "l_suppkey", "left")
            .select("l_orderkey", "l_linenumber", F.coalesce("size", F.col("l_quantity").cast("int")).alias("credits"),
                    "syllabus", "goals"))


@query("view_class_grain", """
SELECT o.o_orderkey, list_sort(coalesce(list(DISTINCT l.l_returnflag) FILTER (l.l_returnflag IS NOT NULL), [])) AS versions,
 list_sort(coalesce(list(DISTINCT p.p_type) FILTER (p.p_type IS NOT NULL), [])) AS kinds, min(l.l_linenumber) AS first_line
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1""")
def view_class_grain(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_returnflag", "l_linenumber")
    kinds = lines.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    rows = relate.distinct_arrays(t.orders.select("o_orderkey"), "o_orderkey", {
        "versions": (lines, "l_returnflag"), "kinds": (kinds, "p_type")})
    return rows.join(lines.groupBy("o_orderkey").agg(F.min("l_linenumber").alias("first_line")), "o_orderkey", "left")


@query("view_left_chain", """
SELECT c.c_custkey, o.o_orderkey, n.n_name FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND o.o_orderstatus = 'F'""")
def view_left_chain(t):
    c = relate.left_many(t.customer.select("c_custkey", "c_nationkey"),
                         t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus"), "c_custkey")
    n = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    return c.join(n, "c_nationkey", "left").select(
        "c_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("name")).alias("n_name"))


@query("view_filtered_counts", """
SELECT c.c_custkey, count(o.o_orderkey) AS n_orders, round(sum(coalesce(o.o_totalprice, 0)), 2) AS total,
 count(*) FILTER (WHERE o.o_orderstatus = 'F') AS n_final, count(*) FILTER (WHERE o.o_orderpriority = '1-URGENT') AS n_urgent
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1""")
def view_filtered_counts(t):
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("o_orderkey").alias("n_orders"), F.round(F.sum(F.coalesce("o_totalprice", F.lit(0.0))), 2).alias("total"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_final"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"))
    return t.customer.select("c_custkey").join(per, "c_custkey", "left").na.fill(0)


@query("view_lateral_agg", """
SELECT c.c_custkey, d.n_docs, d.last_final, coalesce(d.labels, []) AS labels FROM customer c LEFT JOIN LATERAL (
 SELECT count(*) AS n_docs, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS last_final,
  list_sort(list(DISTINCT o_orderpriority)) AS labels FROM orders o WHERE o.o_custkey = c.c_custkey) d ON true""")
def view_lateral_agg(t):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    per = o.groupBy("c_custkey").agg(F.count("*").alias("n_docs"),
                                     F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("last_final"))
    base = t.customer.select("c_custkey").join(per, "c_custkey", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    return relate.distinct_arrays(base, "c_custkey", {"labels": (o, "o_orderpriority")})


@query("lateral_top1", """
SELECT c.c_custkey, d.o_orderkey, d.o_orderdate FROM customer c LEFT JOIN LATERAL (
 SELECT o_orderkey, o_orderdate FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_orderdate, o_orderkey LIMIT 1) d ON true""")
def lateral_top1(t):
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    first = dedup.keep_one(o, ["c_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return t.customer.select("c_custkey").join(first, "c_custkey", "left")


TREE_SQL = """edges AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS title FROM region
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier)"""


@query("recursive_tree", f"""WITH RECURSIVE {TREE_SQL},
tree AS (SELECT id, title AS path, 0 AS level FROM edges WHERE parent IS NULL
 UNION ALL SELECT e.id, t.path || ' › ' || e.title, t.level + 1 FROM edges e JOIN tree t ON t.id = e.parent)
SELECT id AS item, path, level FROM tree""")
def recursive_tree(t):
    edges = (t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("title"))
             .unionByName(t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("title")))
             .unionByName(t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.col("s_name").alias("title"))))
    return relate.tree_paths(edges, item="id", parent="parent", title="title")


@query("ancestor_paths", """WITH RECURSIVE
p AS (SELECT p_partkey AS id, p_partkey // 12 AS parent FROM part),
w AS (SELECT id AS item, parent AS up, id::VARCHAR AS path, [id] AS seen FROM p
 UNION ALL SELECT w.item, p.parent, p.id || '/' || w.path, list_append(w.seen, p.id) FROM w JOIN p ON p.id = w.up WHERE NOT list_contains(w.seen, w.up))
SELECT item, path FROM w WHERE list_contains(seen, up)""")
def ancestor_paths(t):
    pages = t.part.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 12).cast("bigint").alias("parent"),
                          F.col("p_partkey").cast("string").alias("slug"))
    return relate.ancestor_paths(pages, item="id", parent="parent", slug="slug")


@query("most_recent_per_group", """
SELECT DISTINCT ON (o_orderpriority, coalesce(nullif(o_orderstatus, 'P'), '-')) o_orderkey, o_orderpriority, o_orderdate FROM orders
ORDER BY o_orderpriority, coalesce(nullif(o_orderstatus, 'P'), '-'), year(o_orderdate) DESC, o_orderdate DESC, o_orderkey""")
def most_recent_per_group(t):
    level = F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("-"))
    kept = dedup.keep_one(t.orders, [F.col("o_orderpriority"), level],
                          [-F.year("o_orderdate"), -F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")])
    return kept.select("o_orderkey", "o_orderpriority", "o_orderdate")


@query("two_step_projects", """
WITH proj AS (SELECT o.o_orderkey AS project, CASE WHEN o.o_orderstatus <> 'P' THEN l.l_suppkey END AS coordinator, o.o_orderdate AS start
  FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) l ON l.l_orderkey = o.o_orderkey),
mem AS (SELECT DISTINCT l_orderkey AS project, l_suppkey AS person FROM lineitem WHERE l_linenumber > 1),
people AS (SELECT DISTINCT s_nationkey AS question, s_suppkey AS person FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)),
lim AS (SELECT question, count(*) * 5 AS lim FROM people GROUP BY 1),
led AS (SELECT p.question, j.project, row_number() OVER (PARTITION BY p.question ORDER BY j.start DESC, j.project) AS ord
  FROM proj j JOIN people p ON p.person = j.coordinator),
led2 AS (SELECT led.* FROM led JOIN lim USING (question) WHERE ord <= lim),
cnt AS (SELECT lim.question, lim - coalesce(n, 0) AS room, coalesce(n, 0) < lim // 2 AS short FROM lim LEFT JOIN (SELECT question, count(*) AS n FROM led2 GROUP BY 1) USING (question)),
via AS (SELECT DISTINCT p.question, m.project FROM mem m JOIN people p USING (person) JOIN cnt ON cnt.question = p.question AND short
  JOIN proj j ON j.project = m.project AND j.coordinator IS NOT NULL
  WHERE NOT EXISTS (SELECT 1 FROM people q WHERE q.question = p.question AND q.person = j.coordinator)),
mr AS (SELECT via.question, via.project, row_number() OVER (PARTITION BY via.question ORDER BY j.start DESC, via.project) AS ord FROM via JOIN proj j USING (project))
SELECT question, project, 'coordenador' AS role FROM led2 UNION ALL
SELECT mr.question, project, 'membro' FROM mr JOIN cnt USING (question) WHERE ord <= room""")
def two_step_projects(t):
    first = t.lineitem.filter(F.col("l_linenumber") == 1).groupBy("l_orderkey").agg(F.min("l_suppkey").alias("sup"))
    projects = t.orders.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("project"), F.when(F.col("o_orderstatus") != "P", F.col("sup")).alias("coordinator"),
        F.col("o_orderdate").alias("start"))
    members = t.lineitem.filter(F.col("l_linenumber") > 1).select(
        F.col("l_orderkey").alias("project"), F.col("l_suppkey").alias("person")).distinct()
    people = t.supplier.select(F.col("s_nationkey").alias("question"), F.col("s_suppkey").alias("person"))
    people = people.join(t.lineitem.select(F.col("l_suppkey").alias("person")).distinct(), "person", "left_semi")
    return relate.projects_of_people(people, projects, members)


@query("dossier_customers", """
WITH f AS (SELECT c_custkey AS key, 'cliente' AS section, 1 AS ord, c_name || '; ' || c_mktsegment AS payload FROM customer
 UNION ALL SELECT o_custkey, 'resumo', 1, count(*) || ' pedidos' FROM orders GROUP BY 1
 UNION ALL SELECT o_custkey, 'pedidos', ord, o_orderkey || '=' || o_orderstatus FROM (
   SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS ord FROM orders))
SELECT key, section, ord, payload FROM f""")
def dossier_customers(t):
    counts = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return relate.dossier([
        ("cliente", t.customer, "c_custkey", F.concat_ws("; ", "c_name", "c_mktsegment"), [F.col("c_custkey")], 1),
        ("resumo", counts, "o_custkey", F.concat(F.col("n").cast("string"), F.lit(" pedidos")), [F.col("n")], 1),
        ("pedidos", t.orders, "o_custkey", F.concat(F.col("o_orderkey").cast("string"), F.lit("="), "o_orderstatus"),
         [-F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")], None)])


@query("enrich_array_of_struct", """
WITH x AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, list(s_name || ' <' || n_name || '>' ORDER BY pos, s_name) AS people FROM x JOIN supplier ON s_suppkey = l_suppkey
JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 5000 GROUP BY 1""")
def enrich_array_of_struct(t):
    listed = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("pos"))
    rich = (t.supplier.filter(F.col("s_acctbal") > 5000).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").alias("l_suppkey"), F.format_string("%s <%s>", "s_name", "n_name").alias("card")))
    return listed.join(rich, "l_suppkey").groupBy("l_orderkey").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "card"))), lambda s: s["card"]).alias("people"))


# --- aggregation ------------------------------------------------------------------


@query("unnest_count", """
SELECT brand, count(*) AS n FROM (SELECT DISTINCT l_suppkey, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R')
GROUP BY 1 ORDER BY n DESC, brand""")
def unnest_count(t):
    pairs = (t.lineitem.filter(F.col("l_returnflag") == "R").select("l_suppkey", "l_partkey")
             .join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")), "l_partkey"))
    arrays = pairs.select("l_suppkey", "brand").distinct().groupBy("l_suppkey").agg(F.collect_list("brand").alias("brands"))
    return (arrays.select(F.explode("brands").alias("brand")).groupBy("brand").agg(F.count("*").alias("n"))
            .orderBy(F.col("n").desc(), "brand"))


@query("array_predicates", """
WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS ps FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(ps, '; ') AS joined, len(ps)::INT AS n FROM a WHERE list_contains(ps, '1-URGENT') AND len(ps) > 0""")
def array_predicates(t):
    a = t.orders.select("o_custkey", "o_orderpriority").distinct().groupBy("o_custkey").agg(
        F.array_sort(F.collect_list("o_orderpriority")).alias("ps"))
    return a.filter(F.array_contains("ps", "1-URGENT") & (F.size("ps") > 0)).select(
        "o_custkey", F.array_join("ps", "; ").alias("joined"), F.size("ps").alias("n"))


@query("group_counts_sums", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 1) AS price FROM lineitem GROUP BY 1, 2""")
def group_counts_sums(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum("l_extendedprice"), 1).alias("price"))


@query("group_by_first_seen", """
WITH g AS (SELECT l_orderkey, l_returnflag AS label, min(l_linenumber) AS pos, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, string_agg(label || ': ' || n, chr(10) ORDER BY pos, label) AS body FROM g GROUP BY 1""")
def group_by_first_seen(t):
    g = t.lineitem.groupBy("l_orderkey", F.col("l_returnflag").alias("label")).agg(
        F.min("l_linenumber").alias("pos"), F.count("*").alias("n"))
    line = F.concat("label", F.lit(": "), F.col("n").cast("string"))
    return g.groupBy("l_orderkey").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "label", line.alias("line")))), lambda s: s["line"]), "\n").alias("body"))


@query("matrix_filter", """
WITH m AS (SELECT l_orderkey, l_returnflag AS semester, count(*) AS credits FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, list_sort(list(semester || ':' || credits)) AS rows FROM m WHERE credits = 2 AND semester = 'R' GROUP BY 1""")
def matrix_filter(t):
    m = t.lineitem.groupBy("l_orderkey", F.col("l_returnflag").alias("semester")).agg(F.count("*").alias("credits"))
    recs = m.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(F.struct("semester", "credits")).alias("matriz"))).alias("dados"))
    rows = F.from_json("dados", "matriz ARRAY<STRUCT<semester STRING, credits BIGINT>>")["matriz"]
    kept = F.filter(rows, lambda r: (r["semester"] == "R") & (r["credits"] == 2))
    return recs.select("l_orderkey", F.array_sort(F.transform(
        kept, lambda r: F.concat(r["semester"], F.lit(":"), r["credits"].cast("string")))).alias("rows")).filter(F.size("rows") > 0)


@query("corpus_inventory", " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", count(*) AS n FROM {n}" for n in ("documents", "pages", "benchmark", "conversations", "embeddings", "labels")))
def corpus_inventory(t):
    return relate.table_counts({n: getattr(t, n) for n in ("documents", "pages", "benchmark", "conversations", "embeddings", "labels")})


@query("pivot_year_counts", """
SELECT year(o_orderdate)::INT AS year, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O",
 count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def pivot_year_counts(t):
    return (t.orders.groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O", "P"])
            .count().na.fill(0))


@query("unpivot_long", """
WITH w AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) AS total FROM orders GROUP BY 1)
SELECT o_custkey, 'F' AS quota, f AS seats FROM w UNION ALL SELECT o_custkey, 'O', o FROM w UNION ALL SELECT o_custkey, 'TOTAL', total FROM w""")
def unpivot_long(t):
    w = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("F"),
                                          F.count_if(F.col("o_orderstatus") == "O").alias("O"), F.count("*").alias("Total"))
    long = w.unpivot("o_custkey", ["F", "O", "Total"], "quota", "seats")
    return long.withColumn("quota", F.when(F.lower("quota") == "total", "TOTAL").otherwise(F.col("quota")))


@query("metric_means", """
SELECT event_type, round(avg(value), 4) AS mean, round(min(value), 4) AS low, round(max(value), 4) AS high,
 round(avg(CASE WHEN user_id % 7 <> 0 THEN value END), 4) AS mean_known FROM events GROUP BY 1""")
def metric_means(t):
    return t.events.groupBy("event_type").agg(
        F.round(F.avg("value"), 4).alias("mean"), F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"),
        F.round(F.avg(F.when(F.col("user_id") % 7 != 0, F.col("value"))), 4).alias("mean_known"))


# --- sets ---------------------------------------------------------------------------


@query("union_tagged", """
SELECT 'cliente' AS acervo, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'fornecedor', s_suppkey, s_name FROM supplier""")
def union_tagged(t):
    return (t.customer.select(F.lit("cliente").alias("acervo"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
            .unionByName(t.supplier.select(F.lit("fornecedor").alias("acervo"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))))


@query("array_set_ops", """
WITH a AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS ps, list(DISTINCT o_orderstatus) AS ss FROM orders GROUP BY 1)
SELECT o_custkey, list_sort(list_filter(ps, lambda x: NOT list_contains(['1-URGENT', '5-LOW'], x))) AS informative,
 list_sort(list_intersect(ss, ['F', 'O'])) AS decided FROM a""")
def array_set_ops(t):
    o = t.orders.select("o_custkey", "o_orderpriority", "o_orderstatus").distinct()
    a = o.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("ps"), F.collect_set("o_orderstatus").alias("ss"))
    return a.select("o_custkey", F.array_sort(F.array_except("ps", F.array(F.lit("1-URGENT"), F.lit("5-LOW")))).alias("informative"),
                    F.array_sort(F.array_intersect("ss", F.array(F.lit("F"), F.lit("O")))).alias("decided"))


@query("distinct_rows", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_rows(t):
    return t.customer.select("c_mktsegment", "c_nationkey").distinct()


# --- dedup and integrity ----------------------------------------------------------------


@query("dedup_longest", """
SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS r FROM documents) WHERE r = 1""")
def dedup_longest(t):
    return dedup.longest(t.documents, "source", "text", "doc_id", ["source", "doc_id", "n_chars"])


RICH_SQL = """
s AS (SELECT user_id, event_id AS seq, CASE WHEN event_type <> 'view' THEN event_type END AS kind, CASE WHEN value > 20 THEN value END AS amount,
 CASE WHEN event_id % 3 = 0 THEN '' ELSE props END AS note FROM events),
r AS (SELECT *, (kind IS NOT NULL)::INT + (amount IS NOT NULL)::INT + (note <> '')::INT AS rich FROM s)"""


def _partial_rows(t):
    return t.events.select(
        "user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"),
        F.when(F.col("value") > 20, F.col("value")).alias("amount"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("props")).alias("note"))


@query("dedup_richest", f"""WITH {RICH_SQL}
SELECT user_id, seq, kind, amount, note FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rich DESC, seq) AS k FROM r) WHERE k = 1""")
def dedup_richest(t):
    return dedup.richest(_partial_rows(t), ["user_id"], "seq")


@query("dedup_merge", f"""WITH {RICH_SQL}
SELECT user_id, arg_min(kind, seq) FILTER (kind IS NOT NULL) AS kind, arg_min(amount, seq) FILTER (amount IS NOT NULL) AS amount,
 arg_min(note, seq) FILTER (note <> '') AS note FROM s GROUP BY 1""")
def dedup_merge(t):
    return dedup.merge_first(_partial_rows(t), ["user_id"], "seq", ["kind", "amount", "note"])


@query("duplicate_keys", """
SELECT sha256(text) AS content, coalesce(nullif(lang, 'en'), '-') AS lang, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(t):
    return dedup.duplicate_keys(t.documents, [F.sha2("text", 256).alias("content"),
                                              F.coalesce(F.nullif("lang", F.lit("en")), F.lit("-")).alias("lang")])


@query("reconcile_ids", """
WITH k AS (SELECT l_orderkey, arg_max(l_suppkey, l_linenumber * 100000000 + l_suppkey) AS id FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
n AS (SELECT lower(replace(s_name, '#', '')) AS nk, max(s_suppkey) AS id FROM supplier GROUP BY 1)
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_custkey END, k.id, n.id) AS supp,
 CASE WHEN o_orderstatus = 'F' THEN 'given' WHEN k.id IS NOT NULL THEN 'key' WHEN n.id IS NOT NULL THEN 'name' END AS resolved_by
FROM orders LEFT JOIN k ON l_orderkey = o_orderkey LEFT JOIN n ON nk = 'supplier' || lpad(o_custkey::VARCHAR, 9, '0')""")
def reconcile_ids(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("supp"),
                           T.name_key(F.concat(F.lit("Supplier #"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).alias("person"))
    rows = rows.withColumn("person", F.replace("person", F.lit(" "), F.lit("")))
    by_key = t.lineitem.filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_suppkey").alias("seq"), F.col("l_suppkey").alias("id"))
    by_name = t.supplier.select(T.name_key("s_name").alias("person"), F.col("s_suppkey").alias("seq"), F.col("s_suppkey").alias("id"))
    return dedup.resolve_ids(rows, ("o_orderkey", by_key), ("person", by_name), "supp").select("o_orderkey", "supp", "resolved_by")


@query("derived_bridge", """
WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A')
SELECT l_suppkey, l_partkey, 'aba' AS origin FROM e UNION ALL
SELECT DISTINCT l_suppkey, l_partkey, 'turma' FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.l_suppkey = l.l_suppkey AND e.l_partkey = l.l_partkey)""")
def derived_bridge(t):
    existing = t.lineitem.filter(F.col("l_returnflag") == "A").select("l_suppkey", "l_partkey").distinct().withColumn("origin", F.lit("aba"))
    return dedup.derived_bridge(existing, t.lineitem, ["l_suppkey", "l_partkey"], "turma")


@query("orphan_prune", """
WITH o AS (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus <> 'P'), p AS (SELECT p_partkey AS l_partkey, p_size FROM part WHERE p_size > 5)
SELECT 'sem_pedido' AS reason, count(*) AS removed FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM o)
UNION ALL SELECT 'sem_item', count(*) FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM o) AND l_partkey NOT IN (SELECT l_partkey FROM p)
UNION ALL SELECT 'mantidas', count(*) FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM o) AND l_partkey IN (SELECT l_partkey FROM p)""")
def orphan_prune(t):
    orders = t.orders.filter(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("has_o"))
    parts = t.part.filter(F.col("p_size") > 5).select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("has_p"))
    # One pass over the bridge: keys of parents are unique, so the joins keep its rows.
    marked = t.lineitem.select("l_orderkey", "l_partkey").join(orders, "l_orderkey", "left").join(parts, "l_partkey", "left")
    reason = (F.when(F.col("has_o").isNull(), "sem_pedido").when(F.col("has_p").isNull(), "sem_item").otherwise("mantidas"))
    return marked.groupBy(reason.alias("reason")).agg(F.count("*").alias("removed"))


@query("orphan_kept_rows", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 5)""")
def orphan_kept_rows(t):
    kept = dedup.prune(t.lineitem, t.orders.filter(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])
    kept = dedup.prune(kept, t.part.filter(F.col("p_size") > 5).select(F.col("p_partkey").alias("l_partkey")), ["l_partkey"])
    return kept.select("l_orderkey", "l_linenumber")


@query("dangling_to_null", """
SELECT o_orderkey, CASE WHEN c.c_custkey IS NOT NULL THEN o_custkey END AS c_custkey, (c.c_custkey IS NOT NULL AND o_orderstatus = 'F') AS is_known
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o_custkey""")
def dangling_to_null(t):
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "F").alias("is_known"))
    return dedup.null_dangling(rows, "c_custkey", t.customer.filter(F.col("c_acctbal") > 0), "is_known")


@query("upsert_preserving", """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NOT NULL THEN coalesce(d.lang, l.lang) ELSE l.lang END AS lang,
 CASE WHEN l.doc_id IS NOT NULL THEN l.n ELSE d.n END AS n
FROM (SELECT doc_id, nullif(lang, 'de') AS lang, n_chars AS n FROM documents WHERE n_chars > 200) d
FULL JOIN (SELECT doc_id, 'novo' AS lang, quality::BIGINT AS n FROM labels) l ON l.doc_id = d.doc_id""")
def upsert_preserving(t):
    old = t.documents.filter(F.col("n_chars") > 200).select("doc_id", F.nullif("lang", F.lit("de")).alias("lang"), F.col("n_chars").alias("n"))
    new = t.labels.select("doc_id", F.lit("novo").alias("lang"), F.col("quality").cast("bigint").alias("n"))
    return dedup.upsert(old, new, ["doc_id"], ["lang"])


@query("upsert_replace", """
SELECT doc_id, n_chars AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, toxic::BIGINT FROM labels""")
def upsert_replace(t):
    return dedup.replace_rows(t.documents.select("doc_id", F.col("n_chars").alias("n")),
                              t.labels.select("doc_id", F.col("toxic").cast("bigint").alias("n")), ["doc_id"])


@query("fetch_by_ids", "SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def fetch_by_ids(t):
    return dedup.prune(t.documents, t.labels.filter(F.col("quality") == 1), ["doc_id"]).select("doc_id", "source")


@query("surrogate_ids", """
SELECT c_name AS natural_key, row_number() OVER (ORDER BY c_name) AS id FROM customer""")
def surrogate_ids(t):
    from ..sources import io
    return io.surrogate_ids(t.customer.select(F.col("c_name").alias("natural_key")), ["natural_key"])


# --- carry-forward --------------------------------------------------------------------------


@query("carry_forward", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS label FROM conversations""")
def carry_forward(t):
    marker = F.when(F.col("role") == "user", F.length("text").cast("bigint"))
    return scan.carry_forward(t.conversations, ["conv_id"], ["turn"], marker, "label", F.floor(F.col("turn") / 1024)).select(
        "conv_id", "turn", "label")


@query("faq_group", """
WITH q AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations)
SELECT conv_id, g AS ordem, count(*) FILTER (WHERE role <> 'user') AS answers, min(turn) AS first_turn, sum(length(text)) FILTER (WHERE role <> 'user')::BIGINT AS chars
FROM q WHERE g > 0 GROUP BY 1, 2""")
def faq_group(t):
    g = scan.running_count(t.conversations, ["conv_id"], ["turn"], F.col("role") == "user", "ordem", F.floor(F.col("turn") / 1024))
    answer = F.col("role") != "user"
    return g.filter(F.col("ordem") > 0).groupBy("conv_id", "ordem").agg(
        F.count_if(answer).alias("answers"), F.min("turn").alias("first_turn"),
        F.sum(F.when(answer, F.length("text"))).alias("chars"))


@query("renumber_rows", """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordem FROM events""")
def renumber_rows(t):
    return scan.numbered(t.events, ["user_id"], ["ts", "event_id"], "ordem", F.date_trunc("hour", "ts")).select("user_id", "event_id", "ordem")
