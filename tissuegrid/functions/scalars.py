"""Column expressions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def finite_or_zero(x: Column) -> Column:
    """NULL, NaN and infinities become zero."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def ratio_or_one(x: Column, total: Column) -> Column:
    """Divide by a total; a zero total divides by one."""
    return x / F.when(total == 0, F.lit(1.0)).otherwise(total)


def normal_log_pdf(x: Column, mean: float, std: float) -> Column:
    z = (x - F.lit(float(mean))) / F.lit(float(std))
    return -(z * z) / 2 - F.lit(math.log(std) + 0.5 * math.log(2 * math.pi))


def normal_pdf(x: Column, mean: float, std: float) -> Column:
    return F.exp(normal_log_pdf(x, mean, std))


def inclusion_log_prior(gamma: Column, a: float = 0.5, b: float = 0.5) -> Column:
    """Beta-Bernoulli log prior of a 0/1 inclusion flag; only two values occur."""
    def log_beta(p: float, q: float) -> float:
        return math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q)

    on, off = log_beta(a + 1, b) - log_beta(a, b), log_beta(a, b + 1) - log_beta(a, b)
    return F.when(gamma == 1, F.lit(on)).otherwise(F.lit(off))


def one_hot(label: Column, classes: Sequence) -> Column:
    return F.array(*[F.coalesce((label == F.lit(c)).cast("int"), F.lit(0)) for c in classes])


def upper_all(names: Column) -> Column:
    return F.transform(names, F.upper)


def snake_name(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit(" "), F.lit("_")))


def natural_key(name: Column, width: int = 20) -> Column:
    """Sort key under which runs of digits compare as numbers: digits are zero-padded.

    A run longer than ``width`` keeps its digits, and its length still orders before them.
    """
    text = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))

    def piece(p: Column) -> Column:
        digits = F.regexp_replace(p, r"^0+(?=\d)", "")
        padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
        return F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(padded).cast("string"), 6, "0"), padded)).otherwise(p)

    pieces = F.transform(text, piece)
    # Text and digits alternate starting with text, as an empty string if need be.
    return F.when(name.rlike(r"^\d"), F.concat(F.array(F.lit("")), pieces)).otherwise(pieces)


def polygon_text(points: Column) -> Column:
    """``[(x,y),(x,y)]`` from an array of ``struct<x,y>``; empty text for no polygon."""
    pairs = F.transform(points, lambda p: F.concat(F.lit("("), p["x"].cast("string"), F.lit(","),
                                                   p["y"].cast("string"), F.lit(")")))
    return F.when(F.coalesce(F.size(points), F.lit(0)) > 0,
                  F.concat(F.lit("["), F.concat_ws(",", pairs), F.lit("]"))).otherwise(F.lit(""))


def parse_polygon(text: Column) -> Column:
    """Inverse of ``polygon_text``; spaces allowed, malformed text gives NULL."""
    as_json = F.translate(F.replace(text, F.lit(" "), F.lit("")), "()", "[]")
    pairs = F.from_json(as_json, "array<array<double>>")
    return F.transform(pairs, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def homography(x: Column, y: Column, h: Sequence[Sequence[float]]) -> tuple[Column, Column]:
    """Apply a 3 x 3 projective transform."""
    r = [[F.lit(float(v)) for v in row] for row in h]
    w = r[2][0] * x + r[2][1] * y + r[2][2]
    return (r[0][0] * x + r[0][1] * y + r[0][2]) / w, (r[1][0] * x + r[1][1] * y + r[1][2]) / w


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-10) -> Column:
    """Cosine similarity; a zero vector counts as norm one."""
    na, nb = norm(a), norm(b)
    na = F.when(na == 0, F.lit(1.0)).otherwise(na)
    nb = F.when(nb == 0, F.lit(1.0)).otherwise(nb)
    return dot(a, b) / (na * nb + F.lit(eps))
