"""Spatial graphs as edge tables ``(src, dst[, weight])``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuegrid.functions.scalars import cosine
from tissuegrid.operators.neighbors import knn_join


def points(df: DataFrame, axes: list[str], *keep: str) -> DataFrame:
    return df.select("id", F.array(*axes).alias("v"), *keep)


def knn_edges(df: DataFrame, axes: list[str], k: int = 10, **how) -> DataFrame:
    """Directed edges from each node to its ``k`` nearest others."""
    p = points(df, axes)
    return knn_join(p, p, k, exclude_self=True, **how).select(
        F.col("query_id").alias("src"), F.col("ref_id").alias("dst"), "distance", "rank")


def symmetric(edges: DataFrame) -> DataFrame:
    """Union of edges and their reverses, each once."""
    e = edges.select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def _same_label(edges: DataFrame, labels: DataFrame) -> DataFrame:
    a = labels.select(F.col("id").alias("src"), F.col("label").alias("_a"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("_b"))
    return edges.join(a, "src").join(b, "dst").where(F.col("_a") == F.col("_b")).select("src", "dst")


def slice_edges(cells: DataFrame, axes: list[str], k: int = 10, by: str | None = "slice_id") -> DataFrame:
    """Directed within-slice edges; the region label filters after the k nearest are chosen."""
    p = cells.select("id", F.array(*axes).alias("v"), *([by] if by else []))
    near = knn_join(p, p, k, by=by, exclude_self=True).select(
        F.col("query_id").alias("src"), F.col("ref_id").alias("dst"))
    return _same_label(near, cells)


def between_slice_edges(cells: DataFrame, axes: list[str], k: int) -> DataFrame:
    """From each cell to its ``k`` nearest cells of the next slice in order, same label only.

    ``slice_rank`` numbers the slices 0, 1, 2, ... in stacking order.
    """
    v = F.array(*axes).alias("v")
    lower = cells.select("id", v, F.col("slice_rank").alias("gap"))
    upper = cells.select("id", v, (F.col("slice_rank") - 1).alias("gap"))
    near = knn_join(lower, upper, k, by="gap").select(
        F.col("query_id").alias("src"), F.col("ref_id").alias("dst"))
    return _same_label(near, cells)


def stacked_edges(cells: DataFrame, axes: list[str], k: int = 10) -> DataFrame:
    """Whole 3-d network: directed edges in a slice, symmetric edges to the next slice."""
    inside = slice_edges(cells, axes, k, by="slice_rank")
    across = symmetric(between_slice_edges(cells, axes, k // 2))
    return inside.unionByName(across)


def edge_cosine(edges: DataFrame, features: DataFrame) -> DataFrame:
    """Cosine similarity of the two ends, on the listed edges only."""
    a = features.select(F.col("id").alias("src"), F.col("v").alias("_va"))
    b = features.select(F.col("id").alias("dst"), F.col("v").alias("_vb"))
    return edges.join(a, "src").join(b, "dst").select(
        "src", "dst", cosine(F.col("_va"), F.col("_vb")).alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree"))


def normalized(edges: DataFrame, nodes: DataFrame, self_loops: str = "none") -> DataFrame:
    """``D^-1/2 A D^-1/2``. Self loops: ``none``, ``before`` or ``after`` normalising."""
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    e = edges.select("src", "dst", "weight")
    if self_loops == "before":
        e = e.unionByName(loops)
    deg = degrees(e)
    a = deg.select(F.col("id").alias("src"), F.col("degree").alias("_a"))
    b = deg.select(F.col("id").alias("dst"), F.col("degree").alias("_b"))
    # A node without outgoing weight gets factor zero.
    out = e.join(a, "src").join(b, "dst").select(
        "src", "dst", (F.col("weight") / F.sqrt(F.col("_a") * F.col("_b"))).alias("weight"))
    if self_loops == "after":
        out = out.unionByName(loops).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return out
