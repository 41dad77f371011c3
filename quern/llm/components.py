"""Connected components by alternating stars: each round writes a table, so lost executors cost little."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import stash


#: Edges in a file of a round's table.
FILE_EDGES = 20_000


class UnionFind:
    """Over 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.parent[b] = a
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], dtype=np.int64)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of stars of an edge list: (node, smallest node of its tree), roots left out."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    u = UnionFind(len(nodes))
    for x, y in zip(back[: len(a)].tolist(), back[len(a) :].tolist(), strict=True):
        u.union(x, y)
    roots = u.roots()
    at = np.flatnonzero(roots != np.arange(len(nodes)))
    return nodes[at], nodes[roots[at]]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of an edge list (a, b) of longs; label is the smallest node reachable.

    Large star: each node hands its larger neighbours to its smallest one. Small star: it hands its
    smaller ones and itself to the smallest. Both keep the components; a fixed point is a set of stars.
    Minima are aggregated before the shuffle and joined back by a key of their own, so that Spark can split the rows of a hot node.
    """
    edges = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, parts = None, None
    while True:
        large = _star(edges.union(edges.select("b", "a")).toDF("u", "v"), larger=True)
        small = _star(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), larger=False)
        stars = small.distinct()
        edges = stash(stars.coalesce(parts) if parts else stars, "stars", drop=(edges,))
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
        # Rounds never add edges, so the next one's table needs no more files than its rows fill.
        parts = 1 + state["n"] // FILE_EDGES
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())


def join_grouped(rows: DataFrame, grouped: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with an aggregate by the same long key, of which one value may have a great part of the rows.

    An aggregate is already dealt out by its key, and a join on it then reads both sides unsplit. By another, equivalent key both are shuffled for
    the join alone, where Spark (AQE) splits what is too large.
    """
    other = F.col(key).bitwiseXOR(F.lit(0x5555555555555555)).alias("__key")
    return rows.withColumn("__key", other).join(grouped.select(other, *(c for c in grouped.columns if c != key)), "__key", how).drop("__key")


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("v0")).select("u", F.least("u", "v0").alias("m"))
    joined = join_grouped(pairs, least, "u")
    if larger:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m").toDF("a", "b"))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
