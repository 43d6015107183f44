"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a pair of aggregations and joins on node ids. A node with very many neighbours is
combined before its shuffle in the aggregations; in the joins its edges stay where they are and meet
a broadcast table of such nodes, of which there are ``HUBS`` at most, as each has more than its share
of all edges.
Nothing is collected but one checksum row for each round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Most nodes of the broadcast table, and the fewest edges of a node in it.
HUBS = 100_000
LEAST_HUB = 64


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) of the given edges, without self loops."""
    nodes, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    half = len(left)
    for x, y in zip(flat[:half].tolist(), flat[half:].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    top = np.fromiter((root(x) for x in range(len(nodes))), dtype=np.int64, count=len(nodes))
    moved = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[moved], nodes[top[moved]]


def _joined(edges: DataFrame, low: DataFrame, most: int) -> DataFrame:
    """``edges`` with the ``low`` of their ``a``; ``low``: ``(a, n, low)``, n edges of each node."""
    hubs = low.where(F.col("n") > most).select(F.col("a").alias("hub"), F.col("low").alias("hub_low"))
    known = edges.join(F.broadcast(hubs), F.col("a") == F.col("hub"), "left")
    rest = known.where("hub is null").select("a", "b").join(low.where(F.col("n") <= most).select("a", "low"), "a")
    return known.where("hub is not null").select("a", "b", F.col("hub_low").alias("low")).union(rest.select("a", "b", "low"))


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.count("*").alias("n"), F.least(F.min("b"), F.col("a")).alias("low"))
    return _joined(both, low, most).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = down.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("low"))
    moved = _joined(down, low, most).where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select("a", F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` of long node ids to ``(node, root)``, root the smallest node reachable.

    Returns only nodes that have an edge to another node, roots included. Repeated edges, self
    loops and both directions are welcome; an edge with a null end is ignored.
    """
    edges = edges.select("a", "b").where("a <> b")
    stars = materialize(edges.distinct(), "edges")
    before = None
    while True:
        most = max(LEAST_HUB, -(-2 * stars.count() // HUBS))
        large = materialize(_large_star(stars, most), "large-stars")
        stars = materialize(_small_star(large, most), "stars")
        row = stars.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (row.n, row.x) == before or not row.n:
            break
        before = (row.n, row.x)
    roots = stars.select(F.col("b").alias("a"), "b").distinct()
    return stars.union(roots).select(F.col("a").alias("node"), F.col("b").alias("root"))
