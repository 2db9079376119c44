"""Outlines of several rings: which ring lies in which, and the parts and holes that follow.

A cell's outline is a table of vertices with a ring number. Rings of a cell may touch in points but do
not cross. How many rings hold a ring decides its role: an even number makes it the outside of a part,
an odd number a hole of the part around it. Only cells with more than one ring are looked at.

Containment is a sweep over horizontal strips. A cell with many edges gets as many strips as keep few
edges in each; an edge stands in every strip it spans, and one probe point per ring meets the edges of
its strip that cross its height. The cell and strip are the key, so one outline with very many rings is
dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuegrid.operators import geometry as ge
from tissuegrid.session import materialize

#: Edges per strip that a cell's outline is cut for.
STRIP_EDGES = 256


def ring_edges(vertices: DataFrame) -> DataFrame:
    """``(cell_id, ring, seq, x, y)`` -> ``(cell_id, ring, pos, x1, y1, x2, y2)``; closing repeats leave no edge."""
    one = vertices.select(F.struct("cell_id", "ring").alias("cell_id"), "seq", "x", "y")
    edges = ge.ring_edges(one).where("x1 <> x2 OR y1 <> y2")
    return edges.select("cell_id.cell_id", "cell_id.ring", "pos", "x1", "y1", "x2", "y2")


def explode_outlines(outlines: DataFrame) -> DataFrame:
    """``(cell_id, rings array<array<struct<x,y>>>)`` -> vertices, rings numbered from 0."""
    rings = outlines.select("cell_id", F.posexplode("rings").alias("ring", "points"))
    return rings.select("cell_id", "ring", F.posexplode("points").alias("seq", "p")).select(
        "cell_id", "ring", "seq", "p.x", "p.y")


def ring_sums(edges: DataFrame) -> DataFrame:
    """Per ring: twice the area and its moments (made positive), length, box, and a probe point on its first edge."""
    c = F.col("x1") * F.col("y2") - F.col("y1") * F.col("x2")
    middle = F.struct(((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    sums = edges.groupBy("cell_id", "ring").agg(
        F.count(F.lit(1)).alias("n_edges"), F.sum(c).alias("a2"), F.sum((F.col("x1") + F.col("x2")) * c).alias("sx"),
        F.sum((F.col("y1") + F.col("y2")) * c).alias("sy"),
        F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length"),
        F.min("x1").alias("x_min"), F.max("x1").alias("x_max"), F.min("y1").alias("y_min"), F.max("y1").alias("y_max"),
        F.min_by(middle, "pos").alias("probe"))
    turn = F.when(F.col("a2") < 0, -1).otherwise(1)
    return sums.withColumns({"sx": F.col("sx") * turn, "sy": F.col("sy") * turn, "a2": F.abs("a2")})


def nest(edges: DataFrame, sums: DataFrame, strip_edges: int = STRIP_EDGES) -> DataFrame:
    """``(cell_id, ring, depth, parent, part, hole)`` for every ring.

    ``depth`` counts the rings around it, ``parent`` is the smallest of them (null outside all), ``part``
    the ring that bounds the part it belongs to.
    """
    several = sums.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n_rings"), F.sum("n_edges").alias("_n"), F.min("y_min").alias("_low"),
        F.max("y_max").alias("_high")).where("n_rings > 1")
    strips = F.greatest(F.lit(1), F.ceil(F.col("_n") / strip_edges)).cast("long")
    several = several.select("cell_id", "_low", strips.alias("_strips"), F.greatest(
        (F.col("_high") - F.col("_low")) / strips, F.lit(1e-300)).alias("_height"))

    def strip(y: Column) -> Column:
        at = F.floor((y - F.col("_low")) / F.col("_height"))
        return F.least(F.greatest(at, F.lit(0)), F.col("_strips") - 1)

    boxes = sums.select("cell_id", "ring", "x_min", "x_max", "y_min", "y_max", "a2")
    spread = edges.join(several, "cell_id").join(boxes, ["cell_id", "ring"]).select(
        "cell_id", F.explode(F.sequence(strip(F.least("y1", "y2")), strip(F.greatest("y1", "y2")))).alias("strip"),
        F.struct(F.col("a2"), F.col("ring")).alias("around"), "x1", "y1", "x2", "y2", "x_min", "x_max", "y_min", "y_max")
    probes = sums.join(several, "cell_id").select(
        "cell_id", strip(F.col("probe.y")).alias("strip"), "ring", F.col("probe.x").alias("px"), F.col("probe.y").alias("py"))
    reached = (
        (F.col("around.ring") != F.col("ring")) & F.col("px").between(F.col("x_min"), F.col("x_max"))
        & F.col("py").between(F.col("y_min"), F.col("y_max")) & ((F.col("y1") <= F.col("py")) != (F.col("y2") <= F.col("py")))
        & (F.col("x1") + (F.col("py") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")) > F.col("px")))
    holders = probes.join(spread, ["cell_id", "strip"]).where(reached).groupBy("cell_id", "ring", "around").agg(
        F.count(F.lit(1)).alias("_crossings")).where("_crossings % 2 = 1")
    depth = holders.groupBy("cell_id", "ring").agg(F.count(F.lit(1)).alias("depth"), F.min("around").alias("_around"))
    placed = sums.select("cell_id", "ring").join(depth, ["cell_id", "ring"], "left")
    hole = F.coalesce(F.col("depth") % 2 == 1, F.lit(False))
    return placed.select(
        "cell_id", "ring", F.coalesce("depth", F.lit(0)).alias("depth"), F.col("_around.ring").alias("parent"),
        F.when(hole, F.col("_around.ring")).otherwise(F.col("ring")).alias("part"), hole.alias("hole"))


def part_measures(nested: DataFrame, sums: DataFrame) -> DataFrame:
    """Per part ``(cell_id, part)``: area without its holes, length of all its rings, area centroid, number of holes."""
    sign = F.when(F.col("hole"), -1).otherwise(1)
    total = lambda c: F.sum(F.col(c) * sign)
    return nested.join(sums, ["cell_id", "ring"]).groupBy("cell_id", "part").agg(
        (total("a2") / 2).alias("area"), F.sum("length").alias("perimeter"),
        F.try_divide(total("sx"), 3 * total("a2")).alias("centroid_x"),
        F.try_divide(total("sy"), 3 * total("a2")).alias("centroid_y"),
        F.sum(F.col("hole").cast("long")).alias("n_holes"))


def outline_measures(vertices: DataFrame, strip_edges: int = STRIP_EDGES) -> DataFrame:
    """One row per cell from ``(cell_id, ring, seq, x, y)``: counts over all parts, measures of the largest part.

    ``total_area`` covers all parts. Area, perimeter, centroid, circularity and ``radius`` (greatest distance
    from the centroid to a vertex of the outside) are those of the part of greatest area, on ties of the least
    ring number; ``ring`` names its outside. Rings of fewer than three vertices are dropped, as are rings
    without area; a cell left without a ring gives no row.
    """
    edges = materialize(ring_edges(vertices), "edges")
    sums = materialize(ring_sums(edges).where("a2 > 0"), "rings")
    parts = part_measures(nest(edges, sums, strip_edges), sums)
    first = F.struct("area", (-F.col("part")).alias("order"))
    cells = parts.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("n_holes").alias("n_holes"), F.sum("area").alias("total_area"),
        F.max_by(F.struct("part", "area", "perimeter", "centroid_x", "centroid_y"), first).alias("p"))
    cells = materialize(cells.select(
        "cell_id", "n_parts", "n_holes", "total_area", F.col("p.part").alias("ring"), "p.area", "p.perimeter",
        "p.centroid_x", "p.centroid_y", ge.circularity(F.col("p.area"), F.col("p.perimeter")).alias("circularity")), "outlines")
    d = F.hypot(F.col("x1") - F.col("centroid_x"), F.col("y1") - F.col("centroid_y"))
    reach = edges.join(cells.select("cell_id", "ring", "centroid_x", "centroid_y"), ["cell_id", "ring"]).groupBy(
        "cell_id").agg(F.coalesce(F.max(d), F.lit(0.0)).alias("radius"))
    return cells.join(reach, "cell_id")


def outside_rings(vertices: DataFrame, outlines: DataFrame) -> DataFrame:
    """``(cell_id, polygon)``: the outside of the part that ``outlines`` names, a closing repeat left out."""
    chosen = vertices.join(outlines.select("cell_id", "ring"), ["cell_id", "ring"], "left_semi")
    rings = ge.ring_arrays(chosen)
    closed = F.element_at("polygon", 1) == F.element_at("polygon", -1)
    return rings.withColumn("polygon", F.when(closed, F.slice("polygon", 1, F.size("polygon") - 1)).otherwise(F.col("polygon")))
