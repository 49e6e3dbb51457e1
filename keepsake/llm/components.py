"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _star(sided: DataFrame, only_larger: bool) -> DataFrame:
    """Links a node's neighbours (u's v) to the smallest of the node and those neighbours.

    The minimum is combined before its shuffle, and the join back is one that Spark can split by
    size, so a node with very many neighbours is never gathered in one task.
    """
    least = sided.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    linked = sided.join(least, "u")
    if only_larger:
        return linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    # The node itself is linked as well; it is emitted from the minima, once a node.
    return (linked.select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node that it reaches.

    Each round is a large star (neighbours above a node move to its minimum) and a small star (neighbours
    below it do); the number of rounds grows with the logarithm of the longest chain. Nodes are of any
    ordered type. Self-loops and nulls are ignored; a node without an edge has no row.
    """
    now = cut(edges.select("a", "b").filter("a <> b").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen or mark["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = mark
        large = _star(_both_ways(now), True).distinct()
        # All edges now point down (a > b), so a node's smaller neighbours are its b.
        now = cut(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u > v"), False).distinct())
