"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Distinct vectors are dealt to shards by hash. Each shard is built by one task as a layered graph: a vector gets a random
top layer, is linked on each of its layers to close and mutually distant neighbours found by greedy beam search, and the
links of a layer lie in one flat array of neighbour numbers with a fixed width. A search descends from the entry point
and sweeps the lowest layer with a beam. Blocks of queries meet every shard, each shard gives its best with exact cosines
in double precision, and these are merged.

Rows with the same vector share one place in a graph, with their k + 1 least ids; more cannot be among the k nearest, so
a vector that very many rows have costs no more than any other.

Edge cases: vectors that are NULL, of length zero, all zero, or hold NULL or non-finite components take no part, as rows
without an id. Vectors meet only vectors of their own length. Repeated ids with one vector count once; a query's own id
is never among its neighbours. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

K = 5
#: Every how many ids is a query; vectors of a shard; queries of a block.
QUERY_STEP, SHARD, QUERY_BLOCK = 50, 8192, 512
#: Links per vector and layer (twice that on the lowest), beam of the building and of the search.
LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 64, 256


class Graph:
    """Unit vectors and, per layer, a flat array of neighbour numbers (-1: none)."""

    def __init__(self, unit: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 1):
        self.unit, n = np.ascontiguousarray(unit, np.float32), len(unit)
        self.width = (2 * links, links)
        draws = np.random.default_rng(seed).random(n)
        top = np.minimum((-np.log(1 - draws) / math.log(links)).astype(int), 12) if n else np.zeros(0, int)
        self.layers = [np.full((n, self.width[0]), -1, np.int32)]
        # Upper layers hold few vectors: `place` gives a vector's line in the layer's array.
        self.place = [np.arange(n, dtype=np.int32)]
        for layer in range(1, int(top.max(initial=0)) + 1):
            members = np.flatnonzero(top >= layer)
            place = np.full(n, -1, np.int32)
            place[members] = np.arange(len(members))
            self.place.append(place)
            self.layers.append(np.full((len(members), links), -1, np.int32))
        self.entry, self.high = 0, int(top[0]) if n else 0
        for i in range(1, n):
            self._insert(i, int(top[i]), beam)

    def _near(self, query: np.ndarray, starts: list[int], layer: int, beam: int, seen: np.ndarray, mark: int) -> list[tuple[float, int]]:
        """The closest vectors met by a beam search on one layer: (similarity, number), best first."""
        links, place, unit = self.layers[layer], self.place[layer], self.unit
        near = unit[starts] @ query
        seen[starts] = mark
        open_ = [(-float(s), i) for s, i in zip(near, starts)]
        heapq.heapify(open_)
        best = [(float(s), i) for s, i in zip(near, starts)]
        heapq.heapify(best)
        while open_:
            s, i = heapq.heappop(open_)
            if len(best) >= beam and -s < best[0][0]:
                break
            around = links[place[i]]
            around = around[around >= 0]
            around = around[seen[around] != mark]
            if not len(around):
                continue
            seen[around] = mark
            for x, j in zip((unit[around] @ query).tolist(), around.tolist()):
                if len(best) < beam:
                    heapq.heappush(best, (x, j))
                    heapq.heappush(open_, (-x, j))
                elif x > best[0][0]:
                    heapq.heapreplace(best, (x, j))
                    heapq.heappush(open_, (-x, j))
        return sorted(best, reverse=True)

    def _apart(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Of the candidates, best first, those closer to the vector than to any chosen one; then the best of the rest."""
        ids = np.array([i for _, i in near])
        if len(ids) <= most:
            return ids.tolist()
        among = self.unit[ids] @ self.unit[ids].T
        chosen: list[int] = []
        for k, (s, _) in enumerate(near):
            if not chosen or s > among[k, chosen].max():
                chosen.append(k)
                if len(chosen) == most:
                    break
        if len(chosen) < most:
            taken = set(chosen)
            chosen += [k for k in range(len(ids)) if k not in taken][:most - len(chosen)]
        return ids[chosen].tolist()

    def _insert(self, i: int, top: int, beam: int) -> None:
        query, seen = self.unit[i], self._seen()
        at = [self.entry]
        for layer in range(self.high, top, -1):
            at = [self._near(query, at, layer, 1, seen, self._mark())[0][1]]
        for layer in range(min(top, self.high), -1, -1):
            near = self._near(query, at, layer, beam, seen, self._mark())
            chosen = self._apart(near, LINKS if layer else self.width[0] // 2)
            links, place = self.layers[layer], self.place[layer]
            links[place[i], :len(chosen)] = chosen
            for j in chosen:
                line = links[place[j]]
                free = np.flatnonzero(line < 0)
                if len(free):
                    line[free[0]] = i
                else:
                    ids = np.append(line, i)
                    s = self.unit[ids] @ self.unit[j]
                    order = np.argsort(-s)
                    line[:] = self._apart([(float(s[k]), int(ids[k])) for k in order], len(line))
            at = [j for _, j in near]
        if top > self.high:
            self.entry, self.high = i, top

    def _seen(self) -> np.ndarray:
        if not hasattr(self, "seen"):
            self.seen, self.marks = np.zeros(len(self.unit), np.int64), 0
        return self.seen

    def _mark(self) -> int:
        self.marks += 1
        return self.marks

    def search(self, query: np.ndarray, beam: int = SEARCH_BEAM) -> list[int]:
        if not len(self.unit):
            return []
        seen, at = self._seen(), [self.entry]
        for layer in range(self.high, 0, -1):
            at = [self._near(query, at, layer, 1, seen, self._mark())[0][1]]
        return [i for _, i in self._near(query, at, 0, beam, seen, self._mark())]

    def dump(self) -> bytes:
        out = io.BytesIO()
        flat = {f"l{i}": x for i, x in enumerate(self.layers)} | {f"p{i}": x for i, x in enumerate(self.place)}
        np.savez(out, head=np.array([self.entry, self.high, *self.width]), **flat)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, unit: np.ndarray) -> Graph:
        own, held = cls.__new__(cls), np.load(io.BytesIO(data))
        own.unit = np.ascontiguousarray(unit, np.float32)
        own.entry, own.high, *own.width = map(int, held["head"])
        n = sum(k.startswith("l") for k in held)
        own.layers, own.place = [held[f"l{i}"] for i in range(n)], [held[f"p{i}"] for i in range(n)]
        return own


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, vec (array<double>): the rows that take part."""
    vec = F.col("embedding").cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).filter("vec_id IS NOT NULL AND vec IS NOT NULL")
    return found.filter(~bad & F.exists("vec", lambda x: x != 0))


def _scaled(vec: np.ndarray) -> np.ndarray:
    """Rows times a power of two, exact but for underflow, so that the greatest component is about one."""
    return np.ldexp(vec, -np.frexp(np.abs(vec).max(1, keepdims=True))[1])


def _unit(vec: np.ndarray) -> np.ndarray:
    scaled = _scaled(vec)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _search(shard: pd.DataFrame, queries: pd.DataFrame, k: int, beam: int) -> pd.DataFrame:
    """The k best ids of one shard for one block of queries."""
    out: list[tuple] = []
    if len(shard) and len(queries):
        vec = np.frombuffer(shard["vecs"].iloc[0]).reshape(shard["n"].iloc[0], -1)
        ids = np.frombuffer(shard["ids"].iloc[0], np.int64).reshape(len(vec), -1)
        # Scaled by their greatest component, so that no square of a finite vector overflows or vanishes.
        graph, vec = Graph.load(shard["graph"].iloc[0], _unit(vec)), _scaled(vec)
        length = np.sqrt((vec * vec).sum(1))
        mine = np.stack(queries["vec"].to_numpy())
        for query_id, q, u in zip(queries["query_id"], _scaled(mine), _unit(mine).astype(np.float32)):
            found = np.array(graph.search(u, beam))
            score = (vec[found] * q).sum(1) / (length[found] * math.sqrt((q * q).sum()))
            own = [(-s, i) for s, line in zip(score.tolist(), ids[found].tolist()) for i in line if i >= 0 and i != query_id]
            out += [(query_id, i, -s) for s, i in heapq.nsmallest(k, own)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest(index: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, block: int = QUERY_BLOCK,
            beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (vec_id, vec) its k nearest of the index (vec_id, vec)."""
    scratch = Scratch(index.sparkSession, "ann")
    # The k + 1 least ids of each distinct vector; Spark cuts each task's share to as many before the exchange.
    order = Window.partitionBy("vec").orderBy("vec_id")
    few = index.dropDuplicates(["vec_id", "vec"]).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    distinct = scratch.put("distinct", few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    shards = max(1, math.ceil(distinct.count() / shard))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int")).withColumn("dim", F.size("vec"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ids", key=lambda x: x.map(lambda i: i[0]), kind="stable")
        vec = np.stack(part["vec"].to_numpy())
        ids = np.full((len(part), k + 1), -1, np.int64)
        for line, own in zip(ids, part["ids"]):
            line[:len(own)] = own
        graph = Graph(_unit(vec).astype(np.float32))
        return pd.DataFrame({"dim": [vec.shape[1]], "shard": part["shard"].iloc[:1].tolist(), "n": [len(vec)],
                             "vecs": [vec.tobytes()], "ids": [ids.tobytes()], "graph": [graph.dump()]})

    built = dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, n int, vecs binary, ids binary, graph binary")
    built = scratch.put("graphs", built)
    blocks = max(1, math.ceil(queries.count() / block))
    asked = queries.select(F.col("vec_id").alias("query_id"), "vec", F.size("vec").alias("dim"),
                           F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    served = built.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]
    found = served.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
        lambda a, b: _search(a, b, k, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(rows: DataFrame, step: int = QUERY_STEP) -> DataFrame:
    """The result of query op10_ann."""
    index = usable(rows)
    return nearest(index, index.filter(F.col("vec_id") % step == 0).dropDuplicates(["vec_id"]))
