"""A property graph as two DataFrames: vertices ``(id)`` and edges ``(src, dst[, e])``.

Edges are a multiset: repeated ones stay and count each time.  A vertex exists
if it is listed, or by the loading rules below; an edge may point at an id
that doesn't exist.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool = True

    @staticmethod
    def from_edges(edges: DataFrame, directed: bool = True) -> Graph:
        """Loads edges alone: both ends of each edge become vertices."""
        ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
        return Graph(ends, edges if directed else undirected(edges), directed)

    @staticmethod
    def with_vertices(edges: DataFrame, vertices: DataFrame, directed: bool = True) -> Graph:
        """Loads edges and a vertex list: listed ids and sources exist, and targets only where the graph is undirected."""
        stored = edges if directed else undirected(edges)
        ids = vertices.select("id").union(stored.select(F.col("src").alias("id"))).distinct()
        return Graph(ids, stored, directed)

    def counts(self) -> DataFrame:
        """One row ``num_vertices, num_edges``; edges as stored, so twice the given ones where undirected."""
        v = self.vertices.agg(F.count("*").alias("num_vertices"))
        return v.crossJoin(self.edges.agg(F.count("*").alias("num_edges")))  # of two single rows

    def degrees(self) -> DataFrame:
        """``id, out_degree, in_degree`` of every vertex, counting repeated edges each time."""
        ends = self.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(self.edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        sums = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
        return self.vertices.join(sums, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("out_degree", "in_degree")])

    def out_degrees(self) -> DataFrame:
        sums = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
        return self.vertices.join(sums, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("out_degree"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse; a loop is stored twice."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct pairs of different vertices joined by an edge in either direction, both ways round."""
    return undirected(edges.select("src", "dst")).filter("src <> dst").distinct()
