"""Polygons as vertex and edge tables.

Area, centroid, perimeter and circle overlap are sums over edges, so they aggregate map-side and
a polygon with very many vertices is never gathered into one row. Convex hulls are taken of
bounded chunks first, then of what is left per polygon.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tissuegrid.operators.ranking import row_numbers
from tissuegrid.session import materialize


HULL_CHUNK = 4096
HULL_FAN = 64


# ---- assembly ------------------------------------------------------------------------------

def ring_edges(vertices: DataFrame) -> DataFrame:
    """``(cell_id, seq, x, y)`` -> ``(cell_id, pos, n, x1, y1, x2, y2)``, ring closed.

    ``seq`` gives the vertex order. Rings of fewer than three vertices are dropped.
    """
    placed = row_numbers(vertices.select("cell_id", "seq", "x", "y"), [F.col("seq")], "pos", ["cell_id"])
    placed = materialize(placed.select("cell_id", "pos", "x", "y"), "vertices")
    counts = placed.groupBy("cell_id").agg(F.max("pos").alias("n")).where(F.col("n") >= 3)
    start = placed.join(counts, "cell_id")
    end = placed.select("cell_id", F.col("pos").alias("_next"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return (
        start.withColumn("_next", F.col("pos") % F.col("n") + 1).join(end, ["cell_id", "_next"])
        .select("cell_id", "pos", "n", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    )


def rejected_rings(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("cell_id").agg(F.count("*").alias("n")).where("n < 3")


def ring_arrays(vertices: DataFrame) -> DataFrame:
    """``(cell_id, polygon array<struct<x,y>>)`` for rings small enough to travel as one value."""
    packed = F.sort_array(F.collect_list(F.struct("seq", "x", "y")))
    return vertices.groupBy("cell_id").agg(
        F.transform(packed, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("polygon")
    ).where(F.size("polygon") >= 3)


def explode_rings(polygons: DataFrame) -> DataFrame:
    """Inverse of ``ring_arrays``."""
    return polygons.select("cell_id", F.posexplode("polygon").alias("seq", "p")).select(
        "cell_id", "seq", "p.x", "p.y")


# ---- measures ------------------------------------------------------------------------------

def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def ring_measures(edges: DataFrame) -> DataFrame:
    """Per polygon: area, perimeter, area centroid, box, box centre and vertex count."""
    c = _cross(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    sums = edges.groupBy("cell_id").agg(
        F.count("*").alias("n_vertices"), F.sum(c).alias("_a2"),
        F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("perimeter"),
        F.sum((F.col("x1") + F.col("x2")) * c).alias("_sx"), F.sum((F.col("y1") + F.col("y2")) * c).alias("_sy"),
        F.min("x1").alias("x_min"), F.max("x1").alias("x_max"),
        F.min("y1").alias("y_min"), F.max("y1").alias("y_max"),
    )
    return sums.select(
        "cell_id", "n_vertices", (F.abs("_a2") / 2).alias("area"), "perimeter",
        F.try_divide(F.col("_sx"), 3 * F.col("_a2")).alias("centroid_x"),
        F.try_divide(F.col("_sy"), 3 * F.col("_a2")).alias("centroid_y"),
        "x_min", "x_max", "y_min", "y_max",
        ((F.col("x_min") + F.col("x_max")) / 2).alias("center_x"),
        ((F.col("y_min") + F.col("y_max")) / 2).alias("center_y"),
        ((F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))).alias("box_area"),
        F.try_divide(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")).alias("aspect_ratio"),
        circularity(F.abs("_a2") / 2, F.col("perimeter")).alias("circularity"),
    )


def circularity(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, 4 * math.pi * area / (perimeter * perimeter)).otherwise(F.lit(0.0))


def ring_radius(edges: DataFrame, measures: DataFrame) -> DataFrame:
    """Largest distance from the area centroid to a vertex."""
    center = measures.select("cell_id", "centroid_x", "centroid_y")
    d = F.hypot(F.col("x1") - F.col("centroid_x"), F.col("y1") - F.col("centroid_y"))
    return edges.join(center, "cell_id").groupBy("cell_id").agg(F.coalesce(F.max(d), F.lit(0.0)).alias("radius"))


def _edge_in_disc(ax: Column, ay: Column, bx: Column, by: Column, r: Column) -> tuple[Column, Column]:
    """Signed area shared by a disc around the origin and the triangle origin-a-b, and whether the edge enters the disc.

    The edge is cut where it meets the circle: the inner piece spans a triangle, the outer
    pieces span sectors.
    """
    dx, dy = bx - ax, by - ay
    a, b, c = dx * dx + dy * dy, ax * dx + ay * dy, ax * ax + ay * ay - r * r
    disc = b * b - a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    length = F.when(a > 0, a)
    t1 = F.least(F.greatest((-b - root) / length, F.lit(0.0)), F.lit(1.0))
    t2 = F.least(F.greatest((-b + root) / length, F.lit(0.0)), F.lit(1.0))

    def sector(px, py, qx, qy):
        return r * r / 2 * F.atan2(_cross(px, py, qx, qy), px * qx + py * qy)

    px, py, qx, qy = ax + t1 * dx, ay + t1 * dy, ax + t2 * dx, ay + t2 * dy
    inner = _cross(px, py, qx, qy) / 2
    head = F.when(t1 > 0, sector(ax, ay, px, py)).otherwise(F.lit(0.0))
    tail = F.when(t2 < 1, sector(qx, qy, bx, by)).otherwise(F.lit(0.0))
    meets = (disc > 0) & (t1 < t2)
    area = F.when(a == 0, F.lit(0.0)).when(meets, head + inner + tail).otherwise(sector(ax, ay, bx, by))
    return area, F.coalesce(meets, F.lit(False))


def circle_overlap(edges: DataFrame, circles: DataFrame) -> DataFrame:
    """Fraction of each polygon's area inside a circle: ``circles(spot_id, cell_id, cx, cy, r)``.

    Where no edge enters the disc, the ring goes round it a whole number of times: without rounding
    that count, a polygon beside the disc would share a hair of area with it.
    """
    rel = [F.col("x1") - F.col("cx"), F.col("y1") - F.col("cy"),
           F.col("x2") - F.col("cx"), F.col("y2") - F.col("cy")]
    joined = edges.join(circles, "cell_id")
    area, enters = _edge_in_disc(*rel, F.col("r"))
    sums = joined.groupBy("spot_id", "cell_id").agg(
        F.sum(area).alias("_in"), F.max(enters).alias("_enters"), (math.pi * F.max("r") * F.max("r")).alias("_disc"),
        F.sum(_cross(*rel) / 2).alias("_all"))
    whole = F.coalesce(F.round(F.try_divide(F.col("_in"), F.col("_disc"))), F.lit(0.0)) * F.col("_disc")
    share = F.try_divide(F.abs(F.when(F.col("_enters"), F.col("_in")).otherwise(whole)), F.abs("_all"))
    return sums.select("spot_id", "cell_id",
                       F.least(F.coalesce(share, F.lit(0.0)), F.lit(1.0)).alias("frac"))


# ---- convex hull -----------------------------------------------------------------------------

def _hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull, collinear points removed."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts)
    chains = []
    for seq in (pts, reversed(pts)):
        chain: list[tuple[float, float]] = []
        for p in seq:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2], chain[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    return np.array(chains[0] + chains[1])


POINTS = "array<struct<x: double, y: double>>"


_ARRAYS = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("x", "y")])


@F.pandas_udf(_ARRAYS)
def _hull_of(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    hulls = [_hull(np.column_stack([x, y])) for x, y in zip(xs, ys)]
    return pd.DataFrame({"x": [h[:, 0] for h in hulls], "y": [h[:, 1] for h in hulls]})


def _diameter(hull: np.ndarray) -> float:
    """Greatest distance of two hull corners: each side is paired with the corner farthest from it.

    Sides of a hull turn one way, so the corner opposite a side is where the sides have turned by half a circle.
    """
    n = len(hull)
    if n < 3:
        return float(np.hypot(*(hull[-1] - hull[0]))) if n else float("nan")
    side = np.roll(hull, -1, axis=0) - hull
    angle = np.arctan2(side[:, 1], side[:, 0])
    turn = np.mod(angle - angle[0], 2 * math.pi)
    # Rounding may put the last sides a hair beyond the full turn, or neighbours out of order.
    turn[1:][turn[1:] == 0] = 2 * math.pi
    turn = np.maximum.accumulate(turn)
    half = turn + math.pi
    far = np.searchsorted(np.r_[turn, turn + 2 * math.pi], half)
    here, best = np.arange(n), 0.0
    for a in (here, here + 1):
        for off in (-1, 0, 1):
            gap = hull[a % n] - hull[(far + off) % n]
            best = max(best, float(np.hypot(gap[:, 0], gap[:, 1]).max()))
    return best


@F.pandas_udf(T.DoubleType())
def _diameter_of(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series([_diameter(np.column_stack([x, y])) for x, y in zip(xs, ys)], dtype=float)


def _merged(hulls: DataFrame, into) -> DataFrame:
    """Hulls ``h`` of the same ``into`` as one."""
    joined = hulls.groupBy("cell_id", "n_points", into.alias("_chunk")).agg(
        F.flatten(F.collect_list("h.x")).alias("x"), F.flatten(F.collect_list("h.y")).alias("y"))
    return joined.select("cell_id", "n_points", "_chunk", _hull_of("x", "y").alias("h"))


def hull_points(points: DataFrame) -> DataFrame:
    """``(cell_id, x, y)`` -> ``(cell_id, hull array<struct<x,y>>, n_points)``.

    Chunks of bounded size are reduced to their hulls first; a hull of hulls is the hull. Hulls are merged
    in levels, ``HULL_FAN`` at a time, so a task holds points of hulls only, however many chunks a key has.
    """
    n = points.groupBy("cell_id").agg(F.count("*").alias("n_points"))
    chunk = F.pmod(F.xxhash64("x", "y"), F.ceil(F.col("n_points") / HULL_CHUNK))
    # Copies of a point first: all would fall into one chunk.
    part = points.select("cell_id", F.col("x").cast("double"), F.col("y").cast("double")).distinct().join(n, "cell_id").groupBy(
        "cell_id", "n_points", chunk.alias("_chunk")).agg(F.collect_list("x").alias("x"), F.collect_list("y").alias("y"))
    reduced = part.select("cell_id", "n_points", "_chunk", _hull_of("x", "y").alias("h"))
    most = n.agg(F.max("n_points")).first()[0] or 1
    left = -(-most // HULL_CHUNK)
    while left > HULL_FAN:
        left = -(-left // HULL_FAN)
        reduced = _merged(reduced, F.floor(F.col("_chunk") / HULL_FAN))
    whole = _merged(reduced, F.lit(0).cast("long"))
    hull = F.arrays_zip("h.x", "h.y").cast(POINTS)
    return whole.select("cell_id", hull.alias("hull"), "n_points")


def hull_edges(hulls: DataFrame) -> DataFrame:
    """Edges of each hull, in order."""
    size = F.size("hull")
    return hulls.select("cell_id", "hull", F.posexplode("hull").alias("pos", "p")).select(
        "cell_id", F.col("pos"), F.col("p.x").alias("x1"), F.col("p.y").alias("y1"),
        F.col("hull")[(F.col("pos") + 1) % size]["x"].alias("x2"),
        F.col("hull")[(F.col("pos") + 1) % size]["y"].alias("y2"))


def shape_features(points: DataFrame) -> DataFrame:
    """Shape of a point cloud: size, solidity, diameters, box measures, eccentricity.

    The largest diameter is attained on the hull, the smallest is the shortest hull side.
    """
    hulls = materialize(hull_points(points), "hulls")
    sides = hull_edges(hulls)
    side = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    widest = hulls.select("cell_id", _diameter_of("hull.x", "hull.y").alias("max_diameter"))
    per = sides.groupBy("cell_id").agg(
        (F.abs(F.sum(_cross(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))) / 2).alias("hull_area"),
        F.min(side).alias("min_diameter"), F.min("x1").alias("_x0"), F.max("x1").alias("_x1"),
        F.min("y1").alias("_y0"), F.max("y1").alias("_y1"))
    w, h = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    area = F.col("n_points").cast("double")
    ratio = F.try_divide(F.col("min_diameter"), F.col("max_diameter"))
    return per.join(widest, "cell_id").join(hulls.select("cell_id", "n_points"), "cell_id").select(
        "cell_id", area.alias("area"), F.try_divide(area, F.col("hull_area")).alias("solidity"),
        "max_diameter", "min_diameter", F.try_divide(w, h).alias("aspect_ratio"),
        F.sqrt(1 - ratio * ratio).alias("eccentricity"),
        F.sqrt(4 * area / math.pi).alias("equivalent_diameter"), (w * h).alias("bounding_box_area"))


def inside_hull(cells: DataFrame, spots: DataFrame) -> DataFrame:
    """Keep cells inside the convex hull of all spots (boundary included)."""
    one = hull_points(spots.select(F.lit(0).alias("cell_id"), "x", "y"))
    boxed = cells.withColumn("_h", one.select("hull").scalar()).withColumn("_n", F.size("_h"))
    turns = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda i: _cross(
            F.col("_h")[(i + 1) % F.col("_n")]["x"] - F.col("_h")[i]["x"],
            F.col("_h")[(i + 1) % F.col("_n")]["y"] - F.col("_h")[i]["y"],
            F.col("x") - F.col("_h")[i]["x"], F.col("y") - F.col("_h")[i]["y"]))
    return boxed.where(F.forall(turns, lambda c: c >= 0)).drop("_h", "_n")


# ---- tissue mask -----------------------------------------------------------------------------

def in_tissue(cells: DataFrame, patches: DataFrame | None, patch: int = 256,
              width: int | None = None, height: int | None = None) -> DataFrame:
    """Keep cells whose pixel (half-to-even rounded) lies in a square patch ``[x, x + patch)``.

    Without patches every cell is kept. The union of squares is never rasterised: patches and
    cells meet on a grid of the patch size.
    """
    if patches is None:
        return cells
    px, py = F.rint("x").cast("long"), F.rint("y").cast("long")
    located = cells.withColumn("_px", px).withColumn("_py", py).where("_px >= 0 AND _py >= 0")
    if width is not None:
        located = located.where(F.col("_px") < width)
    if height is not None:
        located = located.where(F.col("_py") < height)
    located = located.withColumn("_gx", F.floor(F.col("_px") / patch)).withColumn("_gy", F.floor(F.col("_py") / patch))
    corners = patches.select(F.col("x").alias("_qx"), F.col("y").alias("_qy")).distinct()
    both = F.array(F.lit(0), F.lit(1))
    tiles = (
        corners.withColumn("_i", F.explode(both)).withColumn("_j", F.explode(both))
        .withColumn("_gx", F.floor(F.col("_qx") / patch) + F.col("_i"))
        .withColumn("_gy", F.floor(F.col("_qy") / patch) + F.col("_j"))
    )
    covered = (
        (located["_gx"] == tiles["_gx"]) & (located["_gy"] == tiles["_gy"])
        & located["_px"].between(tiles["_qx"], tiles["_qx"] + patch - 1)
        & located["_py"].between(tiles["_qy"], tiles["_qy"] + patch - 1)
    )
    return located.join(tiles, covered, "left_semi").drop("_px", "_py", "_gx", "_gy")
