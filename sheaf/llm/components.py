"""Connected components of edges too many for one machine, by alternating stars.

Each partition first joins its own edges into a spanning forest. Then, round by round, every node's larger
neighbours are hung on its smallest one (large star), and its smaller neighbours on the smallest of them
(small star), until nothing changes: about log(n) rounds, each written to the shared folder. A node with very
many neighbours is met by partial aggregates, and the smallest neighbours are written before they are joined, so
that they are broadcast if few and else both inputs of the join are plain exchanges, whose hot partitions the
adaptive join splits.

Self-loops, repeated edges and either direction are fine; edges with a null end are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import hand_back, stored
from sheaf.session import lookup_side


EDGES = "a long, b long"


class Forest:
    """Union-find over numbers; the smallest of a tree is its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (above := up.get(top, top)) != top:
            top = above
        while (above := up.get(x, x)) != top:
            up[x], x = top, above
        return top

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def stars(self) -> tuple[list[int], list[int]]:
        nodes = list(self.up)
        return [self.root(n) for n in nodes], nodes


def edge_table(stars: tuple[list[int], list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()) for s in stars], names=["a", "b"])


# Nodes whose tree a task keeps before it hands its stars on and starts anew.
KEPT_NODES = 1_000_000


def local_stars(edges: DataFrame) -> DataFrame:
    """In each partition, stars with the same components as its edges."""

    def run(batches):
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if a != b:
                    forest.join(a, b)
            if len(forest.up) > KEPT_NODES:
                yield edge_table(forest.stars())
                forest = Forest()
        yield edge_table(forest.stars())
        del forest
        hand_back()

    return edges.mapInArrow(run, EDGES)


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = lookup_side(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")


def small_star(edges: DataFrame) -> DataFrame:
    """Takes and gives edges with a < b."""
    least = lookup_side(edges.groupBy("b").agg(F.min("a").alias("m")))
    moved = edges.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b"))


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node that has an edge to another one."""
    a, b = edges.columns
    edges = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b")
    mark = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")]
    current = stored(local_stars(edges).distinct(), "edges")
    before = current.agg(*mark).first()
    while before["n"]:
        larger = stored(large_star(current), "stars")
        current = stored(local_stars(small_star(larger)).distinct(), "edges")
        after = current.agg(*mark).first()
        if after == before:
            break
        before = after
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
