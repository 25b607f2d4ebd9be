"""Connected components of a graph given by its edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import apart, remove, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
    return both.where("b > a").join(apart(least), F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them. In each edge a > b."""
    least = edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    met = edges.join(apart(least), F.col("a") == F.col("n"))
    down = met.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of one type -> (node, root) for every node of a component but its root, the smallest node.

    Repeated edges, loops and both directions may occur; edges with a null end are left out. The rounds
    grow with the logarithm of the longest chain. Each is written to the shared folder.
    """
    now = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
        if state == mark or not state["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, old = state, now
        now = written(_small_star(_large_star(now)), "edges")
        remove(old)
