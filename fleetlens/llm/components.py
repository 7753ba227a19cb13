"""Connected components of an edge table, by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long): root is the smallest node it reaches.

    Each round merges every node into its smallest neighbour and contracts the edges, which at
    least halves the nodes left; tables of a round are written to the shared folder. Minima
    are taken per task before the shuffle, so a node with many edges is no hot group.
    """
    edges = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        near = edges.select(F.col("a").alias("node"), F.col("a").alias("low")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("low")))
        step = stage(near.groupBy("node").agg(F.min("low").alias("low")), "step")
        if labels is None:
            labels = step.select("node", F.col("low").alias("root"))
        else:
            moved = labels.join(step.select(F.col("node").alias("root"), "low"), "root", "left")
            labels = stage(moved.select("node", F.coalesce("low", "root").alias("root")), "labels")
        a, b = step.select(F.col("node").alias("a"), F.col("low").alias("low_a")), step.select(F.col("node").alias("b"), F.col("low").alias("low_b"))
        met = edges.join(a, "a").join(b, "b").filter("low_a <> low_b")
        edges = stage(met.select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
