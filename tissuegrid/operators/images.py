"""Stain channels on pixel tables ``(patch_id, px, py, r, g, b)``; ``px, py`` count within a patch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuegrid.operators.ranking import quantiles

# Stain vectors of the two colour models.
HEMATOXYLIN = (0.60968, 0.65246, 0.45010)
EOSIN = (0.21306, 0.87722, 0.43022)
STAIN_MATRIX = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))

RGB = ("r", "g", "b")


def _density(channel: str) -> Column:
    clipped = F.least(F.greatest(F.col(channel).cast("double"), F.lit(1.0)), F.lit(255.0))
    return -F.log(clipped / 255 + F.lit(1e-8))


def _weighted(weights, columns: list[Column]) -> Column:
    terms = [F.lit(float(w)) * c for w, c in zip(weights, columns)]
    return terms[0] + terms[1] + terms[2]


def project_stains(pixels: DataFrame) -> DataFrame:
    """Optical density projected on the unit stain vectors: columns ``h`` and ``e``."""
    od = [_density(c) for c in RGB]
    unit = {n: np.array(v) / np.linalg.norm(v) for n, v in (("h", HEMATOXYLIN), ("e", EOSIN))}
    return pixels.select("*", *[_weighted(v, od).alias(n) for n, v in unit.items()])


def stretch(stained: DataFrame, low: float = 0.01, high: float = 0.99, step: int = 4) -> DataFrame:
    """Per-patch percentile stretch to 0..255, with percentiles from every ``step``-th pixel.

    Adds ``h_level, e_level`` and their whole parts ``h8, e8``.
    """
    sample = stained.where((F.col("px") % step == 0) & (F.col("py") % step == 0))
    out = stained
    for c in ("h", "e"):
        q = quantiles(sample, c, {f"{c}_lo": low, f"{c}_hi": high}, ["patch_id"])
        lo, hi = F.coalesce(F.col(f"{c}_lo"), F.lit(0.0)), F.coalesce(F.col(f"{c}_hi"), F.lit(1.0))
        value = (F.least(F.greatest(F.col(c), lo), hi) - lo) * (F.lit(255.0) / F.greatest(hi - lo, F.lit(1e-6)))
        out = out.join(q, "patch_id", "left").withColumn(f"{c}_level", value)
        out = out.withColumn(f"{c}8", F.floor(f"{c}_level").cast("int")).drop(f"{c}_lo", f"{c}_hi")
    return out


def unmix_stains(pixels: DataFrame) -> DataFrame:
    """Concentrations from the 3 x 3 stain matrix, each channel min-max scaled per patch to 0..255."""
    inverse = np.linalg.inv(np.array(STAIN_MATRIX).T)
    od = [-F.log(F.col(c) / 255.0 + F.lit(1e-6)) for c in RGB]
    mixed = pixels.select("*", _weighted(inverse[0], od).alias("h"), _weighted(inverse[1], od).alias("e"))
    box = mixed.groupBy("patch_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("h", "e")
                                          for n, f in (("lo", F.min), ("hi", F.max))])
    out = mixed.join(box, "patch_id")
    for c in ("h", "e"):
        width = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        scaled = F.when(width > 0, (F.col(c) - F.col(f"lo_{c}")) / width).otherwise(F.lit(0.0))
        out = out.withColumn(f"{c}_level", scaled * 255).withColumn(f"{c}8", F.floor(scaled * 255).cast("int"))
    return out.drop("lo_h", "hi_h", "lo_e", "hi_e")


def grey_to_rgb(pixels: DataFrame) -> DataFrame:
    """Single-channel pixels ``(.., grey)`` as RGB."""
    return pixels.select("*", *[F.col("grey").alias(c) for c in RGB]).drop("grey")


def luminance(pixels: DataFrame) -> DataFrame:
    """Grey level 0..255 of RGB pixels (Rec. 709 weights)."""
    grey = F.col("r") * 0.2125 + F.col("g") * 0.7154 + F.col("b") * 0.0721
    return pixels.withColumn("grey", F.floor(grey).cast("int"))
