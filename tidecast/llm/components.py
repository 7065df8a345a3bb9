"""Connected components by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import checkpointed


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour.

    The minima are stored: a join of two shuffles can split the rows of a node that has a large
    part of all edges, one on top of its own aggregation cannot.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")))
    linked = both.join(least, "u").where("v > u")
    return linked.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Needs u > v."""
    least = checkpointed(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(u, v)``; the root is the smallest node.

    Both steps keep the components and only lower the endpoints, so the loop ends in stars; the
    number of rounds grows with the logarithm of the nodes. Every round is checkpointed. Only two
    totals a round reach the driver.
    """
    graph = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    graph, before = checkpointed(graph.distinct()), None
    while True:
        totals = graph.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if totals == before or totals[0] == 0:
            return graph.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                graph.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = totals
        graph = checkpointed(small_star(large_star(graph)))
