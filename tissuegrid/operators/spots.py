"""Which cells lie in which spots, and how much of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuegrid.operators.geometry import circle_overlap
from tissuegrid.operators.neighbors import knn_join
from tissuegrid.operators.sampling import cap_per_spot
from tissuegrid.session import materialize


def nearest_spots(cells: DataFrame, spots: DataFrame, diameter: float, axes=("x", "y"), **how) -> DataFrame:
    """``(spot_id, cell_id, distance)``: the nearest spot of each cell, every spot on a tie.

    A spot is accepted up to half the diameter plus the cell's own ``radius``.
    """
    near = knn_join(
        cells.select(F.col("cell_id").alias("id"), F.array(*axes).alias("v")),
        spots.select(F.col("spot_id").alias("id"), F.array(*axes).alias("v")), 1, ties=True, **how)
    sized = near.join(cells.select(F.col("cell_id").alias("query_id"), "radius"), "query_id")
    return sized.where(F.col("distance") <= F.lit(diameter / 2) + F.col("radius")).select(
        F.col("ref_id").alias("spot_id"), F.col("query_id").alias("cell_id"), "distance")


def _overlap(pairs: DataFrame, spots: DataFrame, edges: DataFrame, diameter: float) -> DataFrame:
    circles = pairs.join(spots, "spot_id").select(
        "spot_id", "cell_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.lit(diameter / 2).alias("r"))
    return circle_overlap(edges, circles)


def overlap_matrix(cells: DataFrame, spots: DataFrame, edges: DataFrame, diameter: float,
                   max_cells: int | None = None, seed: int = 0, **how) -> DataFrame:
    """Spot x cell overlap fractions; zero overlap drops the cell. ``max_cells`` then caps each spot."""
    pairs = nearest_spots(cells, spots, diameter, **how)
    frac = _overlap(pairs, spots, edges, diameter).where("frac > 0")
    return frac if max_cells is None else cap_per_spot(frac, max_cells, seed)


def overlap_from_assignment(assigned: DataFrame, spots: DataFrame, edges: DataFrame, diameter: float,
                            max_cells: int | None = None, seed: int = 0) -> DataFrame:
    """As above for given ``(spot_id, cell_id)``: a cap comes first, zero overlaps are kept.

    Only cells of listed spots remain.
    """
    kept = assigned.join(spots.select("spot_id"), "spot_id", "left_semi")
    kept = materialize(kept if max_cells is None else cap_per_spot(kept, max_cells, seed), "kept")
    frac = _overlap(kept, spots, edges, diameter)
    return kept.join(frac, ["spot_id", "cell_id"], "left").withColumn("frac", F.coalesce("frac", F.lit(0.0)))


def binary_assignment(assigned: DataFrame) -> DataFrame:
    return assigned.select("spot_id", "cell_id").distinct().withColumn("frac", F.lit(1.0))
