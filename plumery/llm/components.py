"""Connected components of a graph given as a table of edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumery.operators.graph import LOCAL_EDGES, cut, tied


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node among the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours and the node itself are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(a, b); the root is the smallest node that can be reached.

    Edges may be repeated, in either direction, or loops; loops alone give no row. At most LOCAL_EDGES edges, a few MB, are tied
    in one task, with the same result; more go through rounds of contractions. Each round writes its edges with
    a checkpoint; rounds go on until none changes anything. No list of a node's neighbours is ever built: only minima are grouped, and joins on a busy node are left
    to Spark's skew join.
    """
    edges = edges.select("a", "b").where("a <> b").distinct().transform(cut)
    if edges.count() <= LOCAL_EDGES:
        return tied(edges).select("node", F.col("label").alias("root"))
    sums = None
    while True:
        edges = _small_star(_large_star(edges)).transform(cut)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == sums:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        sums = now
