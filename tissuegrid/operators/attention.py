"""Attention weights on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_softmax(edges: DataFrame, score: str, node: str = "src") -> DataFrame:
    """Softmax of ``score`` over the edges of each node.

    Per-node sums are pre-aggregated before the shuffle, so a hub costs no more than a leaf.
    """
    top = edges.groupBy(node).agg(F.max(score).alias("_m"))
    mass = edges.join(top, node).groupBy(node).agg(
        F.first("_m").alias("_m"), F.sum(F.exp(F.col(score) - F.col("_m"))).alias("_z"))
    return edges.join(mass, node).withColumn(
        "attention", F.exp(F.col(score) - F.col("_m")) / F.col("_z")).drop("_m", "_z")
