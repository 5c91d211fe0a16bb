"""Crawl frontiers over stored pages, tool calls in answers and team matches over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calls, frontier, relate
from .registry import query

SITE = "https://x"

#: Orders stand for courses, parts for subjects, suppliers for staff, nations for projects, regions for units.
GRAPH_SQL = """
seeds AS (SELECT DISTINCT 'https://x/cursos/cod/' || o_orderkey AS url FROM orders WHERE o_orderpriority = '1-URGENT'),
stored AS (SELECT 'https://x/cursos/cod/' || o_orderkey AS url FROM orders UNION SELECT 'https://x/disciplinas/cod/' || p_partkey FROM part WHERE p_size > 10
 UNION SELECT 'https://x/servidores/id/' || s_suppkey FROM supplier UNION SELECT 'https://x/projetos/id/' || n_nationkey FROM nation),
edges AS (SELECT 'https://x/cursos/cod/' || l_orderkey AS source, 'https://x/disciplinas/cod/' || l_partkey AS target FROM lineitem
 UNION SELECT 'https://x/cursos/cod/' || l_orderkey, 'https://x/servidores/id/' || l_suppkey FROM lineitem
 UNION SELECT 'https://x/disciplinas/cod/' || p_partkey, 'https://x/unidades/id/' || p_size FROM part WHERE p_size > 10
 UNION SELECT 'https://x/servidores/id/' || s_suppkey, 'https://x/projetos/id/' || s_nationkey FROM supplier
 UNION SELECT 'https://x/projetos/id/' || n_nationkey, 'https://x/projetos/id/' || (n_nationkey + 1) % 25 FROM nation)"""


def _site(t) -> tuple[DataFrame, DataFrame]:
    """(pages, seeds): a course page is stored in as many rows as it has lines; nations link in a ring."""
    def page(df, path, key, *parts):
        html = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
        return df.select(F.concat(F.lit(SITE + path), F.col(key).cast("string")).alias("url"), html.alias("html"))

    lines = page(t.lineitem, "/cursos/cod/", "l_orderkey", "<h1>Curso</h1><a href='/disciplinas/cod/", F.col("l_partkey"), "#ementa'>Aula</a><a href='https://x/servidores/id/",
                 F.col("l_suppkey"), "'>Pessoa</a><a href='#topo'>topo</a><a href='javascript:voltar()'>voltar</a>")
    made = [page(t.orders, "/cursos/cod/", "o_orderkey", "<p>sem aulas</p>"), lines,
            page(t.part.filter("p_size > 10"), "/disciplinas/cod/", "p_partkey", "<a href='../../unidades/id/", F.col("p_size"), "'>Unidade</a>"),
            page(t.supplier, "/servidores/id/", "s_suppkey", "<a href='/projetos/id/", F.col("s_nationkey"), "'>Projeto</a>"),
            page(t.nation, "/projetos/id/", "n_nationkey", "<a href='", (F.col("n_nationkey") + 1) % 25, "'>seguinte</a><a href='/projetos/id/", F.col("n_nationkey"), "'>este</a>")]
    seeds = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit(SITE + "/cursos/cod/"), F.col("o_orderkey").cast("string")).alias("url"))
    return reduce(DataFrame.unionByName, made), seeds


@query("crawl_frontier", f"""
WITH RECURSIVE {GRAPH_SQL},
r AS (SELECT url, 0 AS depth FROM seeds UNION SELECT target, depth + 1 FROM r JOIN edges ON source = url WHERE depth < 30)
SELECT url, min(depth) AS depth, url IN (SELECT url FROM stored) AS fetched FROM r GROUP BY url""")
def crawl_frontier(t):
    """Every address that urgent orders lead to, over a ring of pages."""
    return frontier.reached(*_site(t))


@query("crawl_phases", f"""
WITH {GRAPH_SQL},
staff AS (SELECT DISTINCT target AS url FROM edges JOIN seeds ON source = url WHERE target LIKE '%/servidores/%'),
r AS (SELECT url, 0 AS depth FROM seeds UNION ALL SELECT DISTINCT target, 1 FROM edges JOIN seeds ON source = url
 UNION ALL SELECT DISTINCT target, 2 FROM edges JOIN staff ON source = url)
SELECT url, depth, url IN (SELECT url FROM stored) AS fetched FROM r""")
def crawl_phases(t):
    """The four phases: courses, their subjects and staff, and the projects of the staff."""
    return frontier.reached(*_site(t), rules=frontier.COURSES)


@query("tool_call_parse", """
WITH f(form, call, name, reason) AS (VALUES (0, 0, 'buscar', NULL), (1, 0, 'buscar', NULL), (1, 1, 'listar', NULL), (2, 0, NULL, 'syntax'), (3, 0, 'detalhe', NULL), (3, 1, NULL, 'not a call'))
SELECT conv_id, turn, 0 AS block, call, name, reason,
 CASE WHEN name = 'buscar' THEN text WHEN name = 'detalhe' THEN 'achar(' || turn || ')' END AS termo,
 CASE WHEN name = 'buscar' THEN turn::VARCHAR WHEN name = 'detalhe' THEN '[1,{"a":null}]' END AS limite
FROM conversations JOIN f ON form = conv_id % 4 WHERE text IS NOT NULL""")
def tool_call_parse(t):
    """Turns put into calls with named, placed, nested and broken arguments, and read back."""
    escaped = F.col("text")
    for mark, code in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(mark), F.lit(code))
    turn = F.col("turn").cast("string")
    forms = [F.concat(F.lit("buscar(termo='"), escaped, F.lit("', limite="), turn, F.lit(")")),
             F.concat(F.lit("[buscar('"), escaped, F.lit("', "), turn, F.lit("), listar()]")),
             F.concat(F.lit("[buscar(termo='"), escaped, F.lit("', limite=")),
             F.concat(F.lit("[detalhe(achar("), turn, F.lit("), limite=[1, {'a': None}]), 'texto']"))]
    block = F.element_at(F.array(*forms), (F.col("conv_id") % 4 + 1).cast("int"))
    said = t.conversations.select("conv_id", "turn", F.concat(F.lit("Vou consultar. <|tool_call_start|>"), block, F.lit("<|tool_call_end|>")).alias("text"))
    found = calls.parsed(said, "text", {"buscar": ["termo", "limite"], "detalhe": ["termo"]})
    given = F.from_json("arguments", "map<string, string>")
    return found.select("conv_id", "turn", "block", "call", "name", "reason", given["termo"].alias("termo"), given["limite"].alias("limite"))


@query("team_member_match", "SELECT DISTINCT l_orderkey AS project, l_suppkey AS person FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def team_member_match(t):
    """Projects of people by the first part of each team entry."""
    named = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    team = F.array(F.concat(F.lower("s_name"), F.lit(" — Coordenador — "), "l_linestatus"), F.lit("Alguém"), F.lit(None).cast("string"))
    projects = named.select(F.col("l_orderkey").alias("project"), team.alias("team"))
    return relate.team_members(projects, t.supplier.select(F.col("s_suppkey").alias("person"), F.col("s_name").alias("name")))
