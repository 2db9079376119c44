"""Rigid alignment of sections and warping of pixel tables ``(image_id, px, py, r, g, b[, a])``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(pairs: DataFrame, axes: list[str]) -> DataFrame:
    """Centroids and centred cross-moments of matched points ``a_*`` and ``b_*``: one row."""
    base = [F.count("*").alias("n")]
    base += [F.avg(f"{s}_{x}").alias(f"m{s}_{x}") for s in "ab" for x in axes]
    base += [F.covar_pop(f"a_{x}", f"b_{y}").alias(f"h_{x}_{y}") for x in axes for y in axes]
    return pairs.agg(*base)


def rigid_transform(pairs: DataFrame, axes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift that best map ``a`` onto ``b``; a reflection is not allowed."""
    row = moments(pairs, axes).first()
    h = np.array([[row[f"h_{x}_{y}"] for y in axes] for x in axes])
    u, _, vt = np.linalg.svd(h)
    flip = np.eye(len(axes))
    flip[-1, -1] = np.sign(np.linalg.det(vt.T @ u.T))
    rot = vt.T @ flip @ u.T
    shift = np.array([row[f"mb_{x}"] for x in axes]) - rot @ np.array([row[f"ma_{x}"] for x in axes])
    return rot, shift


def transform_table(spark, transforms: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    rows = [(k, *map(float, r.ravel()), *map(float, t)) for k, (r, t) in transforms.items()]
    return spark.createDataFrame(
        rows, "image_id string, r00 double, r01 double, r10 double, r11 double, tx double, ty double")


def _move(x, y):
    return (F.col("r00") * x + F.col("r01") * y + F.col("tx"),
            F.col("r10") * x + F.col("r11") * y + F.col("ty"))


def transformed_bounds(sizes: DataFrame, transforms: DataFrame) -> DataFrame:
    """``sizes(image_id, w, h)`` -> integer box of the four moved corners."""
    corners = sizes.join(transforms, "image_id").withColumn("_u", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "_v", F.explode(F.array(F.lit(0), F.lit(1))))
    x, y = _move(F.col("_u") * F.col("w"), F.col("_v") * F.col("h"))
    moved = corners.select("image_id", x.alias("x"), y.alias("y"))
    return moved.groupBy("image_id").agg(
        F.floor(F.min("x")).alias("x_min"), F.floor(F.min("y")).alias("y_min"),
        F.ceil(F.max("x")).alias("x_max"), F.ceil(F.max("y")).alias("y_max"))


def whiten_background(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Opaque alpha; pixels whose mask is black in every channel turn white."""
    m = mask.select("image_id", "px", "py", ((F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0)).alias("_out"))
    out = pixels.join(m, ["image_id", "px", "py"], "left").withColumn("a", F.lit(255))
    for c in ("r", "g", "b"):
        out = out.withColumn(c, F.when(F.col("_out"), F.lit(255)).otherwise(F.col(c)))
    return out.drop("_out")


def warp(pixels: DataFrame, transforms: DataFrame, bounds: DataFrame) -> DataFrame:
    """Forward nearest mapping onto the common canvas; the last source pixel in row order wins.

    Canvas pixels no source reaches stay white and are not stored.
    """
    g = bounds.agg(F.struct(F.min("x_min").alias("x0"), F.min("y_min").alias("y0"),
                            F.max("x_max").alias("x1"), F.max("y_max").alias("y1"))).scalar()
    x, y = _move(F.col("px"), F.col("py"))
    moved = pixels.join(transforms, "image_id").withColumn("_g", g).select(
        "image_id", (x - F.col("_g.x0")).cast("long").alias("gx"), (y - F.col("_g.y0")).cast("long").alias("gy"),
        (F.col("_g.x1") - F.col("_g.x0")).alias("_w"), (F.col("_g.y1") - F.col("_g.y0")).alias("_h"),
        F.struct("py", "px").alias("_at"), F.struct("r", "g", "b", "a").alias("_c"))
    kept = moved.where("gx >= 0 AND gy >= 0 AND gx < _w AND gy < _h")
    return kept.groupBy("image_id", "gx", "gy").agg(F.max_by("_c", "_at").alias("_c")).select(
        "image_id", "gx", "gy", "_c.*")
