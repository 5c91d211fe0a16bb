"""Link frontiers over pages that are already stored: what a crawl from given seeds reaches, round by round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import html as H
from ..functions import text as T

#: Which kind of page leads to which in a crawl of courses, by path.
COURSES = (("/cursos/cod/", "/disciplinas/cod/"), ("/cursos/cod/", "/servidores/id/"), ("/servidores/id/", "/projetos/id/"))


def _linked(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(source, target): the links of each row; a page stored in several rows may have one several times."""
    # All of a page's targets in one expression, behind the explode: filters on them would else repeat it. An outer one, as an
    # inner explode has the size of the list tested before, which makes the list twice.
    targets = F.array_distinct(F.transform(H.hrefs(html), lambda h: H.without_fragment(H.absolute(T.unescape(h), F.col(url)))))
    rows = pages.select(H.without_fragment(F.col(url)).alias("source"), F.explode_outer(targets).alias("target"))
    return rows.filter(F.col("source").isNotNull() & (F.col("target") != "") & (F.col("source") != F.col("target")))


def edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target): each link of a page to another address once; fragments and links to the page itself do not count.

    A page may be stored in several rows. Rows without address or text have no links.
    """
    return _linked(pages, url, html).distinct()


def follows(rules: tuple[tuple[str, str], ...]) -> Column:
    """Whether a link leads from one kind of page to another that the rules name."""
    pairs = [F.contains("source", F.lit(a)) & F.contains("target", F.lit(b)) for a, b in rules]
    return reduce(lambda x, y: x | y, pairs, F.lit(False))


def reached(pages: DataFrame, seeds: DataFrame, rules: tuple[tuple[str, str], ...] | None = None, rounds: int | None = None, url: str = "url",
            html: str = "html") -> DataFrame:
    """(url, depth, fetched): each address once, with the fewest links from a seed and whether a page of it is stored.

    Links are taken from the pages once and written; of them stay those of seeds, which the first round reads, and those of
    pages that some link leads to, which are all that a later round can meet. A round joins these with the addresses that the
    round before found, and keeps those not met yet, so cycles end. Every round is a table in the shared folder, so a lost
    executor repeats one round only, and the addresses found are a table before they are compared with those met, so a short
    round moves none of the latter. A page that everybody links to is one row per round (distinct before the exchange); one
    with many links is split by the skew join. rules: pairs of path pieces (from, to); None follows every link. rounds: None
    goes on until nothing new is found. NULL seeds and seeds met twice add nothing; without pages only the seeds are reached.
    """
    spark = pages.sparkSession
    root = session.run_folder(spark, "frontier")
    # Links repeat little before those that nothing leads to are gone, so they are made distinct by target, round by round.
    found = _linked(pages, url, html)
    (found.filter(follows(rules)) if rules is not None else found).write.parquet(f"{root}/edges")
    links = spark.read.schema("source string, target string").parquet(f"{root}/edges")

    def met(*depths: int) -> DataFrame:
        return spark.read.schema("url string").parquet(*[f"{root}/met/{d}" for d in depths])

    first = seeds.select(H.without_fragment(F.col(seeds.columns[0])).alias("url")).filter("url IS NOT NULL").distinct()
    first.write.parquet(f"{root}/met/0")
    begun = met(0).select("url", F.lit(True).alias("seed"), F.lit(False).alias("linked"))
    ends = links.select(F.col("target").alias("url"), F.lit(False).alias("seed"), F.lit(True).alias("linked")).distinct()
    starts = begun.unionByName(ends).groupBy("url").agg(F.max("seed").alias("seed"), F.max("linked").alias("linked"))
    links.join(starts, F.col("source") == F.col("url")).select("source", "target", "seed", "linked").write.partitionBy(
        "linked", "seed").parquet(f"{root}/followed")
    followed = spark.read.schema("source string, target string, linked boolean, seed boolean").parquet(f"{root}/followed")
    depth = 0
    while (rounds is None or depth < rounds) and not met(depth).isEmpty():
        new = followed.filter("linked").join(met(depth), F.col("source") == F.col("url")) if depth else followed.filter("seed")
        new.select(F.col("target").alias("url")).distinct().write.parquet(f"{root}/new/{depth + 1}")
        new = spark.read.schema("url string").parquet(f"{root}/new/{depth + 1}")
        again = met(*range(depth + 1)).join(new, "url", "left_semi")
        new.join(again, "url", "left_anti").write.parquet(f"{root}/met/{depth + 1}")
        depth += 1
    out = reduce(DataFrame.unionByName, [met(d).withColumn("depth", F.lit(d)) for d in range(depth + 1)])
    stored = pages.select(H.without_fragment(F.col(url)).alias("url"), F.lit(True).alias("fetched")).filter("url IS NOT NULL").distinct()
    return out.join(stored, "url", "left").select("url", "depth", F.coalesce("fetched", F.lit(False)).alias("fetched"))
