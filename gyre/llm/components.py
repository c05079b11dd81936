"""Connected components over an edge table, by union-find in partitions and star steps between them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyre.llm.common import few, written


class UnionFind:
    """Disjoint sets; the smallest member of a set is its root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, x: int, y: int) -> bool:
        """Whether this joined two sets."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        self.parent.setdefault(min(x, y), min(x, y))
        return True


#: Nodes that a task holds at a time.
HELD = 1_000_000
#: Ways in which the neighbours of one node are spread where a step joins by a shuffle.
SALTS = 16


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a partition, replaced by stars around the smallest nodes of their components, HELD nodes at a time."""
    sets = UnionFind()

    def stars() -> pd.DataFrame:
        return pd.DataFrame([(x, root) for x in list(sets.parent) if (root := sets.find(x)) != x], columns=["hi", "lo"], dtype="int64")

    for batch in batches:
        for x, y in zip(batch["hi"].tolist(), batch["lo"].tolist()):
            sets.union(x, y)
        if len(sets.parent) > HELD:
            yield stars()
            sets = UnionFind()
    yield stars()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (hi, lo), hi > lo.

    Large: the larger neighbours of a node move to its smallest neighbour.  Small: a node and its smaller
    neighbours do.  The smallest neighbour is found by a pre-aggregated minimum; it meets the edges by a broadcast if
    there are few nodes, else under SALTS salts, so that a node with very many neighbours is spread.
    """
    ends = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    if large:
        ends = ends.union(edges.select("lo", "hi"))
    least = written(ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    if few(least):
        moved = ends.join(F.broadcast(least), "u")
    else:
        spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        moved = ends.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(spread, ["u", "salt"])
    moved = moved.filter("v > u") if large else moved.select(F.explode(F.array("u", "v")).alias("v"), "m")
    return moved.filter("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a, b), two long columns; component: its smallest reachable node.

    Loops, repeated edges and edges with a null end are ignored; no edges give no rows.  Each round is written
    to the shared folder, so rounds do not pile up lineage.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = written(edges.mapInPandas(_contract, "hi long, lo long").distinct(), name)
    while True:
        tips = edges.select(F.col("hi").alias("lo")).distinct()
        doubled = edges.groupBy("hi").agg(F.count("*").alias("n")).filter("n > 1")
        if edges.join(tips, "lo", "left_semi").isEmpty() and doubled.isEmpty():
            break
        edges = written(_star(written(_star(edges, True), name), False), name)
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(edges.select("lo", "lo").distinct())
