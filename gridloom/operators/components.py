"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.lineage import cut

#: Edges that may be brought to the driver, roots that may be numbered there, and edges whose minima are not cut.
DRIVER_EDGES, TASK_ROOTS, FEW_EDGES = 500_000, 200_000, 2_000_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of (a, b) reaches. Nodes are of any ordered type.

    Large and small stars alternate (Kiveris et al., 2014) until nothing moves. Edges are
    kept as (larger, smaller), so that a large star hangs each larger end on the least
    neighbour of its smaller end, and a small star all smaller ends of a node on the least
    of them. The minima are sums by key, cut from their lineage before they are joined
    back: both sides of the join then have a shuffle of their own, and AQE splits a key
    that holds many of the edges. Up to ``FEW_EDGES`` edges no key is worth that, and the
    minima stay part of the plan. More than ``rounds`` rounds (which grow with the logarithm
    of a component's size, squared at most) raise an error.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    held = edges.count() > FEW_EDGES
    state = None
    for _ in range(rounds):
        least = _least(edges, held)
        large = edges.join(least.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        large = cut(large)
        least = _least(large, held)
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _least(edges: DataFrame, held: bool) -> DataFrame:
    """(u, m): the least smaller end of each node that has one."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return cut(least) if held else least


class UnionFind:
    """Disjoint sets whose name is their least member."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        root = x
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    @classmethod
    def of(cls, edges: Iterable[tuple]) -> UnionFind:
        out = cls()
        for a, b in edges:
            out.union(a, b)
        return out

    def roots(self) -> list[tuple]:
        return [(x, self.find(x)) for x in list(self.parent)]


def components_on_driver(edges: DataFrame, strict: bool = False) -> DataFrame:
    """The same, by a union-find on the driver.

    More than ``DRIVER_EDGES`` edges are left to :func:`components`, or refused if ``strict``.
    """
    edges = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    kind = edges.schema["a"].dataType.simpleString()
    some = edges.limit(DRIVER_EDGES + 1)  # one job finds whether all fit, and brings them
    held = some.toArrow() if kind in ("int", "bigint") else some.collect()
    if len(held) > DRIVER_EDGES:
        if strict:
            raise ValueError("the edges are too many for the driver; use merge='auto' or 'distributed'")
        return components(edges)
    if kind in ("int", "bigint") and len(held):
        nodes, roots = rooted(held.column("a").to_numpy(), held.column("b").to_numpy())
        return edges.sparkSession.createDataFrame(pa.table({"node": nodes, "root": roots}))
    found = UnionFind.of((r["a"], r["b"]) for r in held) if len(held) else UnionFind()
    return edges.sparkSession.createDataFrame(found.roots(), f"node {kind}, root {kind}")


def rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their least reachable node: all edges hook the larger root on the smaller, then paths are halved, until nothing moves."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return nodes, nodes[root]
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root[root] != root).any():
            root = root[root]


def connected(edges: DataFrame, merge: str) -> DataFrame:
    """Components where ``merge`` wants them found."""
    return components(edges) if merge == "distributed" else components_on_driver(edges, strict=merge == "driver")


def with_isolated(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of all ``nodes`` (column ``node``): those without an edge are their own root."""
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def numbered_roots(roots: DataFrame) -> DataFrame:
    """(root, cluster_id): distinct roots numbered from 1 in their order."""
    from gridloom.sources.points import numbered

    roots = roots.select("root").distinct()
    few = sorted(tuple(r)[0] for r in roots.limit(TASK_ROOTS + 1).collect())
    if len(few) <= TASK_ROOTS:
        kind = roots.schema["root"].dataType.simpleString()
        return roots.sparkSession.createDataFrame([(r, k) for k, r in enumerate(few, 1)], f"root {kind}, cluster_id int")
    return numbered(roots, ["root"], "place").select("root", (F.col("place") + 1).cast("int").alias("cluster_id"))
