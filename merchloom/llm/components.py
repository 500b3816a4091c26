"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step links every node to the smallest node it knows; both need one grouped minimum
and one join, so no neighbourhood is ever gathered in a task. Edges shrink to stars whose
centres are the smallest nodes of their components, in a number of rounds that is
logarithmic in the diameter. Every round is written to the shared
folder, and the one before it removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): the smallest node reachable.
    Loops and repeated edges are harmless; an empty table gives an empty one."""
    spark = edges.sparkSession
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # Large star: neighbours above a node are linked to the smallest node of its neighbourhood.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        edges = materialize(small, "edges", replaces=edges, counted=False)
        # Stars are stable: the same edges again, by count and by sum of hashes.
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before = after
    raise RuntimeError(f"components are not stable after {max_rounds} rounds on {spark.sparkContext.applicationId}")
