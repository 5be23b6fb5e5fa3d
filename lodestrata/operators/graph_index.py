"""Vector search by layered graphs (HNSW): one graph per shard of the table, searched greedily, best lists merged.

Every different vector of a shard is a node, with the ids of all rows that have it, so
that copies don't fill each other's links.  A node's level is drawn from a hash of its id, so that each
level has about one in ``m`` of the nodes below it; on every level up to its own it is
linked to near and mutually different nodes.  A search descends from the top level's
entry and, on the lowest, keeps the ``ef`` best nodes that it has met.

Shards are dealt by a hash of the id and have about ``shard_rows`` rows, so that the
build of one fits a task whatever the size of the table, and a search is one task per
shard.  Graphs are written with their vectors as Parquet, a row per node, sorted
within a shard's folder.

Null vectors and those of length 0 are not indexed: no direction is near them.  Rows
that repeat an id are found each for itself.  An empty table gives an empty index.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import retrieval as R

#: Links of a node, and list length while the graph is built.
M, EF_CONSTRUCTION = 16, 64
#: List length of a search, rows of a shard, queries of one search.
EF, SHARD_ROWS, QUERIES = 100, 20_000, 1000


class Graph:
    """vectors: unit vectors, a row per node; links: per level the neighbours of each node."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, m: int = M) -> None:
        self.vectors, self.levels, self.m = vectors, levels, m
        self.links: list[list[list[int]]] = [[[] for _ in range(len(vectors))] for _ in range(int(levels.max(initial=-1)) + 1)]
        self.entry = -1
        #: Vectors that searches have compared.
        self.read = 0

    def _layer(self, query: np.ndarray, entries: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef best nodes of a level that a greedy search from some (likeness, node) meets, the best first."""
        seen = {n for _, n in entries}
        ahead = [(-s, n) for s, n in entries]
        best = list(entries)
        heapq.heapify(ahead)
        heapq.heapify(best)
        links, vectors = self.links[level], self.vectors
        while ahead:
            s, node = heapq.heappop(ahead)
            if len(best) >= ef and -s < best[0][0]:
                break
            new = [n for n in links[node] if n not in seen]
            if not new:
                continue
            seen.update(new)
            self.read += len(new)
            for like, n in zip((vectors[new] @ query).tolist(), new, strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (like, n))
                elif like > best[0][0]:
                    heapq.heapreplace(best, (like, n))
                else:
                    continue
                heapq.heappush(ahead, (-like, n))
        return sorted(best, key=lambda x: (-x[0], x[1]))

    def _spread(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Of nodes, the nearest first, those that are nearer to the centre than to any chosen before; filled up with the nearest."""
        if len(near) <= most:
            return [n for _, n in near]
        nodes = [n for _, n in near]
        alike = self.vectors[nodes] @ self.vectors[nodes].T
        chosen: list[int] = []
        for i, (s, _) in enumerate(near):
            if not chosen or s > alike[i, chosen].max():
                chosen.append(i)
                if len(chosen) == most:
                    break
        have = set(chosen)
        chosen += [i for i in range(len(near)) if i not in have][: most - len(chosen)]
        return [nodes[i] for i in chosen]

    def add(self, node: int, ef: int = EF_CONSTRUCTION) -> None:
        """Links a node whose vector and level are known."""
        level, query = int(self.levels[node]), self.vectors[node]
        if self.entry < 0:
            self.entry = node
            return
        near = [(float(self.vectors[self.entry] @ query), self.entry)]
        top = int(self.levels[self.entry])
        for at in range(top, level, -1):
            near = self._layer(query, near[:1], 1, at)
        for at in range(min(top, level), -1, -1):
            near = self._layer(query, near, ef, at)
            most, links = (2 * self.m if at == 0 else self.m), self.links[at]
            links[node] = self._spread(near, self.m)
            for other in links[node]:
                links[other].append(node)
                if len(links[other]) > most:
                    sims = (self.vectors[links[other]] @ self.vectors[other]).tolist()
                    links[other] = self._spread(sorted(zip(sims, links[other], strict=True), key=lambda x: (-x[0], x[1])), most)
        if level > top:
            self.entry = node

    def search(self, query: np.ndarray, k: int, ef: int = EF) -> list[tuple[float, int]]:
        """(likeness, node) of the k best that are found; with an ef of all nodes the search is exact where the graph is connected."""
        if self.entry < 0:
            return []
        self.read += 1
        near = [(float(self.vectors[self.entry] @ query), self.entry)]
        for at in range(int(self.levels[self.entry]), 0, -1):
            near = self._layer(query, near[:1], 1, at)
        return self._layer(query, near, max(ef, k), 0)[:k]


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).astype(np.float32)


def _levels(hashes: np.ndarray, m: int) -> np.ndarray:
    """Levels from 64-bit hashes: one node in m reaches the next."""
    u = ((hashes.astype(np.int64).view(np.uint64) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.floor(-np.log(u) / math.log(m)).astype(np.int64)


def _built(m: int, ef: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "id"]).reset_index(drop=True)
        given = np.stack(rows["vector"].to_numpy()).astype(np.float64)
        node, first = pd.factorize(pd.Series([v.tobytes() for v in given]))
        at = np.unique(node, return_index=True)[1]
        graph = Graph(_unit(given[at]), _levels(rows["order"].to_numpy()[at], m), m)
        for n in range(len(first)):
            graph.add(n, ef)
        ids = rows["id"].groupby(node).agg(lambda x: sorted(x.tolist()))
        links = [[graph.links[l][n] for l in range(level + 1)] for n, level in enumerate(graph.levels.tolist())]
        return pd.DataFrame({"shard": rows["shard"].iloc[0], "node": np.arange(len(first)), "ids": ids.tolist(), "level": graph.levels, "entry": np.arange(len(first)) == graph.entry, "links": links, "vector": list(given[at])})

    return run


def write_graphs(chunks: DataFrame, path: str, m: int = M, ef: int = EF_CONSTRUCTION, shard_rows: int = SHARD_ROWS, id_col: str = "id", vector_col: str = "embedding") -> None:
    """Graphs of all vectors that have a direction, one per shard."""
    vector = F.col(vector_col).cast("array<double>")
    length = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)
    rows = chunks.select(F.col(id_col).alias("id"), vector.alias("vector"), F.xxhash64(F.col(id_col).cast("string"), F.lit(1)).alias("order"), length.alias("__l")).filter("__l > 0 AND NOT isnan(__l)").drop("__l")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(2)), F.lit(shards)).cast("int"))
    kind = rows.schema["id"].dataType.simpleString()
    graphs = dealt.groupBy("shard").applyInPandas(_built(m, ef), f"shard int, node int, ids array<{kind}>, level int, entry boolean, links array<array<int>>, vector array<double>")
    graphs.write.partitionBy("shard").parquet(path)


def open_graphs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _searched(queries: np.ndarray, k: int, ef: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node").reset_index(drop=True)
        given = np.stack(rows["vector"].to_numpy()).astype(np.float64)
        graph = Graph(_unit(given), rows["level"].to_numpy())
        for node, links in enumerate(rows["links"]):
            for level, others in enumerate(links):
                graph.links[level][node] = others.tolist()
        graph.entry = int(np.flatnonzero(rows["entry"].to_numpy())[0])
        shard, ids, out = int(rows["shard"].iloc[0]), rows["ids"], []
        for number, query in enumerate(queries):
            before = graph.read
            nodes = [n for _, n in graph.search(query.astype(np.float32), k, ef)]
            exact = (given[nodes] @ query) / np.sqrt((given[nodes] ** 2).sum(axis=1))
            rows_of = sorted((-s, i) for s, n in zip(exact.tolist(), nodes, strict=True) for i in ids[n][:k].tolist())  # equal vectors: the smallest ids
            out += [(number, shard, i, -s, graph.read - before, len(rows)) for s, i in rows_of[:k]]
        return pd.DataFrame(out, columns=["query", "shard", "id", "score", "n_read", "n_nodes"])

    return run


def search_all(graphs: DataFrame, queries: Sequence[Sequence[float]], k: int = R.TOP_K, ef: int = EF) -> DataFrame:
    """(query, id, score, rank, n_read, n_nodes) of up to QUERIES query vectors, numbered from 0: the best of all shards, how many vectors were compared for a query, and of how many."""
    if len(queries) > QUERIES:
        raise ValueError(f"at most {QUERIES} queries at once")
    wanted = np.asarray(queries, np.float64).reshape(len(queries), -1)
    length = np.sqrt((wanted * wanted).sum(axis=1, keepdims=True))
    wanted = wanted / np.where(length == 0, 1, length)
    kind = graphs.schema["ids"].dataType.elementType.simpleString()
    found = graphs.groupBy("shard").applyInPandas(_searched(wanted, k, ef), f"query int, shard int, id {kind}, score double, n_read long, n_nodes long")
    counts = found.groupBy("query", "shard").agg(F.first("n_read").alias("n_read"), F.first("n_nodes").alias("n_nodes")).groupBy("query").agg(F.sum("n_read").alias("n_read"), F.sum("n_nodes").alias("n_nodes"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    best = found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("query", "id", "score", "rank")
    return best.join(F.broadcast(counts), "query")  # a row per query, of which there are at most QUERIES


def search(graphs: DataFrame, query: Sequence[float], k: int = R.TOP_K, ef: int = EF) -> DataFrame:
    """(id, score, rank) of the best that the graphs find; the exact way is retrieval.cosine_topk()."""
    return search_all(graphs, [query], k, ef).select("id", "score", "rank")


def recall(graphs: DataFrame, chunks: DataFrame, queries: Sequence[Sequence[float]], k: int = R.TOP_K, ef: int = EF, id_col: str = "id", vector_col: str = "embedding") -> tuple[float, float]:
    """(share of the exact k nearest that are found, share of the vectors compared), over a few queries."""
    found = search_all(graphs, queries, k, ef).toPandas()
    hits = wanted = 0
    for number, q in enumerate(queries):
        exact = {r["id"] for r in R.cosine_topk(chunks, q, k, id_col, vector_col).collect()}
        hits += len(exact & set(found.loc[found["query"] == number, "id"]))
        wanted += len(exact)
    each = found.groupby("query")[["n_read", "n_nodes"]].first().sum()
    return hits / max(1, wanted), float(each["n_read"] / max(1, each["n_nodes"]))
