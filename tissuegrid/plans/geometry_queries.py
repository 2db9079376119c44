"""Polygons, overlaps, registration and stains over the bundled tables.

Each user's events, in order, are the vertices of a star-shaped polygon: equal angles, with the
event value setting the distance from the centre.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tissuegrid.functions import scalars as fx
from tissuegrid.operators import geometry as ge
from tissuegrid.operators import images as ig
from tissuegrid.operators import registration as rg
from tissuegrid.operators import rings as ri
from tissuegrid.operators import spots as sp
from tissuegrid.plans import views as vw
from tissuegrid.plans import workflow as wf
from tissuegrid.plans.registry import query, rounded

VERT = """vt AS (SELECT user_id AS cell_id, event_id AS seq, (10 + value) * cos(2 * pi() * (event_id % 60) / 60.0) + 7 * user_id AS x,
    (10 + value) * sin(2 * pi() * (event_id % 60) / 60.0) + 3 * user_id AS y FROM events),
  vs AS (SELECT cell_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY cell_id) AS n, x AS x1, y AS y1,
    coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
    FROM (SELECT user_id AS cell_id, event_id % 60 AS seq, avg(x) AS x, avg(y) AS y FROM vt JOIN events ON event_id = seq GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY cell_id ORDER BY seq)),
  ed AS (SELECT * FROM vs WHERE n >= 3),
  ms AS (SELECT cell_id, count(*) AS n_vertices, sum(x1 * y2 - y1 * x2) AS a2, sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS per,
    sum((x1 + x2) * (x1 * y2 - y1 * x2)) AS sx, sum((y1 + y2) * (x1 * y2 - y1 * x2)) AS sy,
    min(x1) AS x_min, max(x1) AS x_max, min(y1) AS y_min, max(y1) AS y_max FROM ed GROUP BY 1)"""


def _vertices(t):
    angle = 2 * math.pi * (F.col("event_id") % 60) / 60.0
    return t.events.groupBy(F.col("user_id").alias("cell_id"), (F.col("event_id") % 60).alias("seq")).agg(
        F.avg((10 + F.col("value")) * F.cos(angle) + 7 * F.col("user_id")).alias("x"),
        F.avg((10 + F.col("value")) * F.sin(angle) + 3 * F.col("user_id")).alias("y"))


@query("polygon_measures", f"""WITH {VERT}
SELECT cell_id, n_vertices, round(abs(a2) / 2, 4) AS area, round(per, 4) AS perimeter, round(sx / (3 * a2), 4) + 0.0 AS centroid_x,
  round(sy / (3 * a2), 4) + 0.0 AS centroid_y, round((x_min + x_max) / 2, 4) + 0.0 AS center_x, round((y_min + y_max) / 2, 4) + 0.0 AS center_y,
  round((x_max - x_min) * (y_max - y_min), 4) AS box_area, round((x_max - x_min) / (y_max - y_min), 6) AS aspect_ratio,
  round(4 * pi() * abs(a2) / 2 / (per * per), 6) AS circularity FROM ms""")
def polygon_measures(t):
    m = ge.ring_measures(ge.ring_edges(_vertices(t))).drop("x_min", "x_max", "y_min", "y_max")
    m = rounded(m, "area", "perimeter", "centroid_x", "centroid_y", "center_x", "center_y", "box_area", digits=4)
    return rounded(m, "aspect_ratio", "circularity")


@query("polygon_radius", f"""WITH {VERT}
SELECT cell_id, round(max(sqrt((x1 - sx / (3 * a2)) ** 2 + (y1 - sy / (3 * a2)) ** 2)), 4) AS radius FROM ed JOIN ms USING (cell_id) GROUP BY 1""")
def polygon_radius(t):
    edges = vw.shared(ge.ring_edges(_vertices(t)))
    return rounded(ge.ring_radius(edges, ge.ring_measures(edges)), "radius", digits=4)


# Every user's polygon as an outline of several rings: itself, two smaller copies inside each other about
# its centre, and a copy aside with one hole. Nuclei are the polygon at 0.6 for four users of five.
RINGS = f"""{VERT}, sc AS (SELECT * FROM (VALUES ('cell', 0, 1.0, 0), ('cell', 1, 0.5, 0), ('cell', 2, 0.2, 0), ('cell', 3, 0.9, 5000),
    ('cell', 4, 0.3, 5000), ('nucleus', 0, 0.6, 0)) s(kind, ring, f, dx)),
  rv AS (SELECT kind, cell_id, ring, pos, dx + 7 * cell_id + f * (x1 - 7 * cell_id) AS x1, 3 * cell_id + f * (y1 - 3 * cell_id) AS y1,
    dx + 7 * cell_id + f * (x2 - 7 * cell_id) AS x2, 3 * cell_id + f * (y2 - 3 * cell_id) AS y2 FROM ed, sc
    WHERE CASE kind WHEN 'cell' THEN cell_id % 7 > 0 ELSE cell_id % 5 > 0 END),
  rs AS (SELECT kind, cell_id, ring, abs(sum(x1 * y2 - y1 * x2)) AS a2, sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS len,
    sign(sum(x1 * y2 - y1 * x2)) * sum((x1 + x2) * (x1 * y2 - y1 * x2)) AS sx,
    sign(sum(x1 * y2 - y1 * x2)) * sum((y1 + y2) * (x1 * y2 - y1 * x2)) AS sy,
    min_by((x1 + x2) / 2, pos) AS px, min_by((y1 + y2) / 2, pos) AS py FROM rv GROUP BY 1, 2, 3),
  ho AS (SELECT p.kind, p.cell_id, p.ring, e.ring AS around FROM rs p JOIN rv e ON p.kind = e.kind AND p.cell_id = e.cell_id AND p.ring <> e.ring
    WHERE (e.y1 <= p.py) <> (e.y2 <= p.py) AND e.x1 + (p.py - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1) > p.px
    GROUP BY ALL HAVING count(*) % 2 = 1),
  ne AS (SELECT r.kind, r.cell_id, r.ring, count(h.around) AS depth, min_by(h.around, (o.a2, o.ring)) AS parent FROM rs r
    LEFT JOIN ho h USING (kind, cell_id, ring) LEFT JOIN rs o ON o.kind = h.kind AND o.cell_id = h.cell_id AND o.ring = h.around GROUP BY ALL),
  pa AS (SELECT kind, cell_id, CASE WHEN depth % 2 = 1 THEN parent ELSE ring END AS part, sum(CASE WHEN depth % 2 = 1 THEN -a2 ELSE a2 END) AS a2,
    sum(CASE WHEN depth % 2 = 1 THEN -sx ELSE sx END) AS sx, sum(CASE WHEN depth % 2 = 1 THEN -sy ELSE sy END) AS sy, sum(len) AS len,
    count(*) FILTER (depth % 2 = 1) AS holes FROM ne JOIN rs USING (kind, cell_id, ring) GROUP BY ALL),
  ou AS (SELECT kind, cell_id, count(*) AS n_parts, sum(holes)::BIGINT AS n_holes, sum(a2) / 2 AS total_area,
    unnest(max_by({{'part': part, 'area': a2 / 2, 'per': len, 'cx': sx / (3 * a2), 'cy': sy / (3 * a2)}}, (a2, -part))) FROM pa GROUP BY 1, 2),
  ra AS (SELECT kind, cell_id, max(sqrt((x1 - cx) ** 2 + (y1 - cy) ** 2)) AS radius FROM ou JOIN rv USING (kind, cell_id) WHERE ring = part GROUP BY 1, 2)"""


def _outlines(t):
    cell, f, dx = F.col("cell_id"), F.col("f"), F.col("dx")
    kinds = [("cell", 0, 1.0, 0), ("cell", 1, 0.5, 0), ("cell", 2, 0.2, 0), ("cell", 3, 0.9, 5000), ("cell", 4, 0.3, 5000), ("nucleus", 0, 0.6, 0)]
    copies = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).cast("long").alias("ring"), F.lit(f_).alias("f"), F.lit(d).alias("dx"))
                       for k, r, f_, d in kinds])
    v = vw.shared(_vertices(t)).withColumn("s", F.explode(copies)).select("cell_id", "seq", "x", "y", "s.*")
    v = v.where(F.when(F.col("kind") == "cell", cell % 7 > 0).otherwise(cell % 5 > 0))
    return v.select("kind", "cell_id", "ring", "seq", (dx + 7 * cell + f * (F.col("x") - 7 * cell)).alias("x"),
                    (3 * cell + f * (F.col("y") - 3 * cell)).alias("y"))


@query("ring_nesting", f"""WITH {RINGS}
SELECT cell_id, ring, depth, parent, CASE WHEN depth % 2 = 1 THEN parent ELSE ring END AS part, depth % 2 = 1 AS hole FROM ne WHERE kind = 'cell'""")
def ring_nesting(t):
    """Which ring of an outline lies in which, and the part it belongs to."""
    edges = vw.shared(ri.ring_edges(_outlines(t).where("kind = 'cell'").drop("kind")))
    return ri.nest(edges, vw.shared(ri.ring_sums(edges).where("a2 > 0")))


@query("boundary_table", f"""WITH {RINGS},
  b AS (SELECT ou.*, radius FROM ou JOIN ra USING (kind, cell_id)), c AS (SELECT * FROM b WHERE kind = 'cell'), n AS (SELECT * FROM b WHERE kind = 'nucleus')
SELECT coalesce(c.cell_id, n.cell_id) AS cell_id, round(coalesce(c.cx, n.cx), 4) + 0.0 AS x, round(coalesce(c.cy, n.cy), 4) + 0.0 AS y,
  round(c.area, 4) AS cell_area, round(c.per, 4) AS cell_perimeter, round(4 * pi() * c.area / c.per ** 2, 6) AS cell_circularity,
  c.n_parts AS cell_n_parts, c.n_holes AS cell_n_holes, round(c.total_area, 4) AS cell_total_area,
  round(n.area, 4) AS nucleus_area, round(n.per, 4) AS nucleus_perimeter, round(4 * pi() * n.area / n.per ** 2, 6) AS nucleus_circularity,
  n.n_parts AS nucleus_n_parts, n.n_holes AS nucleus_n_holes, round(n.total_area, 4) AS nucleus_total_area,
  round(coalesce(n.area / c.area, 0.0), 6) AS nucleus_cell_ratio, round(coalesce(c.radius, n.radius), 4) AS circumcircle,
  CASE WHEN coalesce(c.cell_id, n.cell_id) % 3 = 0 THEN 0.5 ELSE 1.0 END AS probability FROM c FULL JOIN n ON c.cell_id = n.cell_id""")
def boundary_table(t):
    """Outlines of cells and nuclei with holes and several parts joined to one table of measures."""
    v = _outlines(t)
    probability = t.events.select(F.col("user_id").alias("cell_id")).distinct().where("cell_id % 3 = 0").withColumn("probability", F.lit(0.5))
    side = lambda kind: v.where(F.col("kind") == kind).drop("kind")
    b = wf.boundary_table(side("cell"), side("nucleus"), probability).drop("polygon")
    b = rounded(b, "cell_circularity", "nucleus_circularity", "nucleus_cell_ratio")
    return rounded(b, "x", "y", "circumcircle", *(f"{k}_{m}" for k in ("cell", "nucleus") for m in ("area", "perimeter", "total_area")), digits=4)


@query("polygon_text", f"""WITH {VERT}, q AS (SELECT cell_id, pos, round(x1)::BIGINT AS x, round(y1)::BIGINT AS y FROM ed)
SELECT cell_id, '[' || string_agg('(' || x::VARCHAR || ',' || y::VARCHAR || ')', ',' ORDER BY pos) || ']' AS polygon,
  count(*) AS n_parsed FROM q GROUP BY 1""")
def polygon_text(t):
    v = _vertices(t).withColumn("x", F.round("x").cast("long")).withColumn("y", F.round("y").cast("long"))
    texts = ge.ring_arrays(v).select("cell_id", fx.polygon_text(F.col("polygon")).alias("polygon"))
    return texts.withColumn("n_parsed", F.size(fx.parse_polygon(F.col("polygon"))).cast("long"))


DISC = """pc AS (SELECT cell_id, spot_id, r, x1 - cx AS ax, y1 - cy AS ay, x2 - cx AS ex, y2 - cy AS ey FROM ed JOIN ci USING (cell_id)),
  p1 AS (SELECT *, ex - ax AS dx, ey - ay AS dy FROM pc),
  p2 AS (SELECT *, dx * dx + dy * dy AS a, ax * dx + ay * dy AS b, ax * ax + ay * ay - r * r AS c FROM p1),
  p3 AS (SELECT *, b * b - a * c AS disc FROM p2),
  p4 AS (SELECT *, least(greatest((-b - sqrt(greatest(disc, 0))) / a, 0), 1) AS t1, least(greatest((-b + sqrt(greatest(disc, 0))) / a, 0), 1) AS t2 FROM p3),
  p5 AS (SELECT *, ax + t1 * dx AS px, ay + t1 * dy AS py, ax + t2 * dx AS qx, ay + t2 * dy AS qy FROM p4),
  p6 AS (SELECT spot_id, cell_id, ax * ey - ay * ex AS c2, CASE WHEN disc > 0 AND t1 < t2 THEN
      CASE WHEN t1 > 0 THEN r * r / 2 * atan2(ax * py - ay * px, ax * px + ay * py) ELSE 0 END + (px * qy - py * qx) / 2 +
      CASE WHEN t2 < 1 THEN r * r / 2 * atan2(qx * ey - qy * ex, qx * ex + qy * ey) ELSE 0 END
    ELSE r * r / 2 * atan2(ax * ey - ay * ex, ax * ex + ay * ey) END AS part FROM p5),
  fr AS (SELECT spot_id, cell_id, least(abs(sum(part)) / abs(sum(c2) / 2), 1) AS frac FROM p6 GROUP BY 1, 2)"""

NEAR = """sz AS (SELECT max(user_id) AS top FROM events), sx AS (SELECT s_suppkey AS spot_id, 7.0 * (s_suppkey * 3 % (top + 1)) + 5 AS cx,
    3.0 * (s_suppkey * 3 % (top + 1)) - 4 AS cy FROM supplier, sz),
  so AS (SELECT min(spot_id) AS spot_id, cx, cy FROM sx GROUP BY 2, 3),
  cc AS (SELECT ms.cell_id, (x_min + x_max) / 2 AS x, (y_min + y_max) / 2 AS y, max(sqrt((x1 - sx / (3 * a2)) ** 2 + (y1 - sy / (3 * a2)) ** 2)) AS radius
    FROM ed JOIN ms USING (cell_id) GROUP BY ALL),
  dd AS (SELECT cell_id, spot_id, radius, cx, cy, round(sqrt((x - cx) ** 2 + (y - cy) ** 2), 10) AS d FROM cc, so),
  nr AS (SELECT *, rank() OVER (PARTITION BY cell_id ORDER BY d) AS rk FROM dd)"""


def _spots(t):
    top = t.events.agg(F.max("user_id") + 1).scalar()
    slot = (F.col("s_suppkey") * 3) % top
    return t.supplier.select("s_suppkey", (7.0 * slot + 5).alias("x"), (3.0 * slot - 4).alias("y")).groupBy("x", "y").agg(
        F.min("s_suppkey").alias("spot_id"))


def _cells(edges):
    m = ge.ring_measures(edges)
    return m.select("cell_id", F.col("center_x").alias("x"), F.col("center_y").alias("y")).join(
        ge.ring_radius(edges, m), "cell_id")


@query("circle_overlap", f"""WITH {VERT}, ci AS (SELECT DISTINCT cell_id, cell_id % 3 AS spot_id, 7.0 * cell_id + 20 AS cx, 3.0 * cell_id - 10 AS cy,
    30.0 + cell_id % 50 AS r FROM ed), {DISC}
SELECT spot_id, cell_id, round(frac, 6) AS frac FROM fr""")
def circle_overlap(t):
    edges = vw.shared(ge.ring_edges(_vertices(t)))
    c = F.col("cell_id")
    circles = edges.select("cell_id").distinct().select(
        "cell_id", (c % 3).alias("spot_id"), (7.0 * c + 20).alias("cx"), (3.0 * c - 10).alias("cy"),
        (30.0 + c % 50).alias("r"))
    return rounded(ge.circle_overlap(edges, circles), "frac")


@query("nearest_spot_join", f"""WITH {VERT}, {NEAR} SELECT spot_id, cell_id, round(d, 4) AS distance FROM nr WHERE rk = 1 AND d <= 20 + radius""")
def nearest_spot_join(t):
    edges = vw.shared(ge.ring_edges(_vertices(t)))
    return rounded(sp.nearest_spots(_cells(edges), _spots(t), 40.0), "distance", digits=4)


@query("overlap_matrix", f"""WITH {VERT}, {NEAR}, ci AS (SELECT spot_id, cell_id, cx, cy, 20.0 AS r FROM nr WHERE rk = 1 AND d <= 20 + radius), {DISC}
SELECT spot_id, cell_id, round(frac, 6) AS frac FROM fr WHERE frac > 0""")
def overlap_matrix(t):
    edges = vw.shared(ge.ring_edges(_vertices(t)))
    return rounded(sp.overlap_matrix(_cells(edges), _spots(t), edges, 40.0), "frac")


@query("overlap_from_assignment", f"""WITH {VERT}, {NEAR}, aa AS (SELECT DISTINCT cell_id, cell_id % 9 AS spot_id FROM ed),
  ci AS (SELECT spot_id, cell_id, cx, cy, 30.0 AS r FROM aa JOIN so USING (spot_id)), {DISC}
SELECT spot_id, cell_id, round(frac, 6) AS frac FROM fr""")
def overlap_from_assignment(t):
    edges = vw.shared(ge.ring_edges(_vertices(t)))
    given = edges.select("cell_id").distinct().withColumn("spot_id", F.col("cell_id") % 9)
    return rounded(sp.overlap_from_assignment(given, _spots(t), edges, 60.0).select("spot_id", "cell_id", "frac"), "frac")


@query("hull_shape_features", f"""WITH {VERT}, pt AS (SELECT cell_id, x1 AS x, y1 AS y FROM vs),
  pr AS (SELECT a.cell_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM pt a JOIN pt b USING (cell_id) WHERE a.x <> b.x OR a.y <> b.y),
  hu AS (SELECT pr.* FROM pr WHERE NOT EXISTS (SELECT 1 FROM pt WHERE pt.cell_id = pr.cell_id AND (x2 - x1) * (pt.y - y1) - (y2 - y1) * (pt.x - x1) < -1e-9)),
  sd AS (SELECT cell_id, sum(x1 * y2 - y1 * x2) / 2 AS ha, min(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS lo FROM hu GROUP BY 1),
  wd AS (SELECT cell_id, max(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS hi FROM pr GROUP BY 1),
  bx AS (SELECT cell_id, count(*)::DOUBLE AS n, max(x) - min(x) AS w, max(y) - min(y) AS h FROM pt GROUP BY 1)
SELECT cell_id, n AS area, round(n / ha, 6) AS solidity, round(hi, 4) AS max_diameter, round(lo, 4) AS min_diameter, round(w / h, 6) AS aspect_ratio,
  round(sqrt(1 - (lo / hi) ** 2), 6) AS eccentricity, round(sqrt(4 * n / pi()), 6) AS equivalent_diameter, round(w * h, 4) AS bounding_box_area
FROM sd JOIN wd USING (cell_id) JOIN bx USING (cell_id)""")
def hull_shape_features(t):
    s = ge.shape_features(_vertices(t).select("cell_id", "x", "y"))
    s = rounded(s, "solidity", "aspect_ratio", "eccentricity", "equivalent_diameter")
    return rounded(s, "max_diameter", "min_diameter", "bounding_box_area", digits=4)


@query("inside_spot_hull", """WITH c AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
  pt AS (SELECT 0.7 * x AS x, 0.7 * y AS y FROM c), pr AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM pt a, pt b WHERE a.x <> b.x OR a.y <> b.y),
  hu AS (SELECT pr.* FROM pr WHERE NOT EXISTS (SELECT 1 FROM pt WHERE (x2 - x1) * (pt.y - y1) - (y2 - y1) * (pt.x - x1) < 0))
SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM hu WHERE (x2 - x1) * (c.y - y1) - (y2 - y1) * (c.x - x1) < 0)""")
def inside_spot_hull(t):
    cells = vw.cells(t).select("id", "x", "y")
    return ge.inside_hull(cells, cells.select((0.7 * F.col("x")).alias("x"), (0.7 * F.col("y")).alias("y"))).select("id")


@query("tissue_mask_filter", """WITH c AS (SELECT l_orderkey AS id, l_linenumber AS line, l_extendedprice / 40 AS x, l_orderkey % 1500 + 0.5 AS y FROM lineitem),
  pa AS (SELECT DISTINCT (s_suppkey * 37 % 2000)::BIGINT AS qx, (s_suppkey * 91 % 1200)::BIGINT AS qy FROM supplier)
SELECT id, line FROM c WHERE EXISTS (SELECT 1 FROM pa WHERE round_even(x, 0) BETWEEN qx AND qx + 255 AND round_even(y, 0) BETWEEN qy AND qy + 255)""")
def tissue_mask_filter(t):
    cells = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
                              (F.col("l_extendedprice") / 40).alias("x"), (F.col("l_orderkey") % 1500 + 0.5).alias("y"))
    patches = t.supplier.select(
        (F.col("s_suppkey") * 37 % 2000).alias("x"), (F.col("s_suppkey") * 91 % 1200).alias("y"))
    return ge.in_tissue(cells, patches).select("id", "line")


# ---- registration and stains -------------------------------------------------------------------

@query("rigid_alignment", """WITH p AS (SELECT embedding[1]::DOUBLE AS ax, embedding[2]::DOUBLE AS ay,
    0.8 * embedding[1]::DOUBLE - 0.6 * embedding[2]::DOUBLE + 0.1 * embedding[4]::DOUBLE + 5 AS ex,
    0.6 * embedding[1]::DOUBLE + 0.8 * embedding[2]::DOUBLE - 0.1 * embedding[5]::DOUBLE - 2 AS ey FROM embeddings),
  m AS (SELECT atan2(covar_pop(ax, ey) - covar_pop(ay, ex), covar_pop(ax, ex) + covar_pop(ay, ey)) AS th,
    avg(ax) AS ma, avg(ay) AS na, avg(ex) AS mb, avg(ey) AS nb FROM p)
SELECT round(cos(th), 6) AS r00, round(-sin(th), 6) AS r01, round(sin(th), 6) AS r10, round(cos(th), 6) AS r11,
  round(mb - (cos(th) * ma - sin(th) * na), 6) AS tx, round(nb - (sin(th) * ma + cos(th) * na), 6) AS ty FROM m""")
def rigid_alignment(t):
    v = vw.cells(t)
    pairs = v.select(
        F.col("x").alias("a_x"), F.col("y").alias("a_y"),
        (0.8 * F.col("x") - 0.6 * F.col("y") + 0.1 * F.col("v")[3] + 5).alias("b_x"),
        (0.6 * F.col("x") + 0.8 * F.col("y") - 0.1 * F.col("v")[4] - 2).alias("b_y"))
    fit = {"all": rg.rigid_transform(pairs, ["x", "y"])}
    out = rg.transform_table(t.spark, fit)
    return rounded(out.drop("image_id"), "r00", "r01", "r10", "r11", "tx", "ty")


PIX = """pix AS (SELECT l_returnflag AS image_id, l_orderkey % 97 AS px, l_partkey % 61 AS py, min(l_quantity * 5)::INT AS r,
    max(l_quantity * 5)::INT AS g, (sum(l_quantity) % 256)::INT AS b FROM lineitem GROUP BY 1, 2, 3),
  sz AS (SELECT image_id, max(px) + 1 AS w, max(py) + 1 AS h FROM pix GROUP BY 1),
  tf AS (SELECT image_id, r00::DOUBLE AS r00, r01::DOUBLE AS r01, r10::DOUBLE AS r10, r11::DOUBLE AS r11, tx::DOUBLE AS tx, ty::DOUBLE AS ty FROM (VALUES ('A', 0.8, -0.6, 0.6, 0.8, 4.0, -3.0), ('N', 1.0, 0.0, 0.0, 1.0, -7.0, 2.0), ('R', 0.0, -1.0, 1.0, 0.0, 0.0, 0.0)) AS v(image_id, r00, r01, r10, r11, tx, ty)),
  cn AS (SELECT image_id, r00 * u * w + r01 * v * h + tx AS x, r10 * u * w + r11 * v * h + ty AS y FROM sz JOIN tf USING (image_id),
    unnest([0, 1]) AS a(u), unnest([0, 1]) AS b(v)),
  bd AS (SELECT image_id, floor(min(x))::BIGINT AS x_min, floor(min(y))::BIGINT AS y_min, ceil(max(x))::BIGINT AS x_max, ceil(max(y))::BIGINT AS y_max FROM cn GROUP BY 1)"""

TRANSFORMS = [("A", 0.8, -0.6, 0.6, 0.8, 4.0, -3.0), ("N", 1.0, 0.0, 0.0, 1.0, -7.0, 2.0), ("R", 0.0, -1.0, 1.0, 0.0, 0.0, 0.0)]


def _pixels(t):
    q = F.col("l_quantity")
    return t.lineitem.groupBy(
        F.col("l_returnflag").alias("image_id"), (F.col("l_orderkey") % 97).alias("px"), (F.col("l_partkey") % 61).alias("py")
    ).agg(F.min(q * 5).cast("int").alias("r"), F.max(q * 5).cast("int").alias("g"), (F.sum(q) % 256).cast("int").alias("b"))


def _transforms(t):
    return t.spark.createDataFrame(
        TRANSFORMS, "image_id string, r00 double, r01 double, r10 double, r11 double, tx double, ty double")


def _bounds(t):
    sizes = _pixels(t).groupBy("image_id").agg((F.max("px") + 1).alias("w"), (F.max("py") + 1).alias("h"))
    return rg.transformed_bounds(sizes, _transforms(t))


@query("transformed_bounds", f"WITH {PIX} SELECT * FROM bd")
def transformed_bounds(t):
    return _bounds(t)


@query("image_warp", f"""WITH {PIX}, g AS (SELECT min(x_min) AS x0, min(y_min) AS y0, max(x_max) - min(x_min) AS w, max(y_max) - min(y_min) AS h FROM bd),
  mv AS (SELECT image_id, trunc(r00 * px + r01 * py + tx - x0)::BIGINT AS gx, trunc(r10 * px + r11 * py + ty - y0)::BIGINT AS gy, px, py,
    CASE WHEN (px + py) % 7 = 0 THEN 255 ELSE r END AS r, CASE WHEN (px + py) % 7 = 0 THEN 255 ELSE g.g2 END AS g, CASE WHEN (px + py) % 7 = 0 THEN 255 ELSE b END AS b
    FROM (SELECT image_id, px, py, r, g AS g2, b FROM pix) g JOIN tf USING (image_id), (SELECT x0, y0 FROM g) gg),
  rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, gx, gy ORDER BY py DESC, px DESC) AS rn FROM mv, (SELECT w, h FROM g) WHERE gx >= 0 AND gy >= 0 AND gx < w AND gy < h)
SELECT image_id, gx, gy, r::INT AS r, g::INT AS g, b::INT AS b, 255::INT AS a FROM rk WHERE rn = 1""")
def image_warp(t):
    pixels = _pixels(t)
    black = F.when((F.col("px") + F.col("py")) % 7 == 0, 0).otherwise(1)
    mask = pixels.select("image_id", "px", "py", *[black.alias(c) for c in "rgb"])
    return rg.warp(rg.whiten_background(pixels, mask), _transforms(t), _bounds(t))


HV = "sqrt(0.60968 ** 2 + 0.65246 ** 2 + 0.45010 ** 2)"
EV = "sqrt(0.21306 ** 2 + 0.87722 ** 2 + 0.43022 ** 2)"
OD = "-ln(least(greatest({c}, 1), 255) / 255.0::DOUBLE + 1e-8)"
STAIN = f"""{PIX}, od AS (SELECT image_id AS patch_id, px, py, {OD.format(c='r')} AS o1, {OD.format(c='g')} AS o2, {OD.format(c='b')} AS o3 FROM pix),
  he AS (SELECT patch_id, px, py, (0.60968::DOUBLE * o1 + 0.65246::DOUBLE * o2 + 0.45010::DOUBLE * o3) / {HV} AS h,
    (0.21306::DOUBLE * o1 + 0.87722::DOUBLE * o2 + 0.43022::DOUBLE * o3) / {EV} AS e FROM od)"""


@query("stain_projection", f"WITH {STAIN} SELECT patch_id, px, py, round(h, 6) + 0.0 AS h, round(e, 6) + 0.0 AS e FROM he")
def stain_projection(t):
    px = _pixels(t).withColumnRenamed("image_id", "patch_id")
    return rounded(ig.project_stains(px).select("patch_id", "px", "py", "h", "e"), "h", "e")


@query("stain_stretch", f"""WITH {STAIN}, q AS (SELECT patch_id, quantile_cont(h, 0.01) AS hl, quantile_cont(h, 0.99) AS hh, quantile_cont(e, 0.01) AS el, quantile_cont(e, 0.99) AS eh
    FROM he WHERE px % 4 = 0 AND py % 4 = 0 GROUP BY 1),
  s AS (SELECT *, (least(greatest(h, hl), hh) - hl) * (255.0 / greatest(hh - hl, 1e-6)) AS hs, (least(greatest(e, el), eh) - el) * (255.0 / greatest(eh - el, 1e-6)) AS es FROM he JOIN q USING (patch_id))
SELECT patch_id, px, py, round(hs, 4) AS h_level, round(es, 4) AS e_level FROM s""")
def stain_stretch(t):
    px = _pixels(t).withColumnRenamed("image_id", "patch_id")
    s = ig.stretch(ig.project_stains(px))
    return rounded(s.select("patch_id", "px", "py", "h_level", "e_level"), "h_level", "e_level", digits=4)


_INV = np.linalg.inv(np.array(ig.STAIN_MATRIX).T)


def _mix_sql(row) -> str:
    return " + ".join(f"({w!r})::DOUBLE * -ln({c} / 255.0::DOUBLE + 1e-6)" for w, c in zip(map(float, row), "rgb"))


@query("stain_unmix", f"""WITH {PIX}, m AS (SELECT image_id AS patch_id, px, py, {_mix_sql(_INV[0])} AS h, {_mix_sql(_INV[1])} AS e FROM pix),
  x AS (SELECT patch_id, min(h) AS h0, max(h) AS h1, min(e) AS e0, max(e) AS e1 FROM m GROUP BY 1)
SELECT patch_id, px, py, round((h - h0) / (h1 - h0) * 255, 4) AS h_level, round((e - e0) / (e1 - e0) * 255, 4) AS e_level FROM m JOIN x USING (patch_id)""")
def stain_unmix(t):
    px = _pixels(t).withColumnRenamed("image_id", "patch_id")
    return rounded(ig.unmix_stains(px).select("patch_id", "px", "py", "h_level", "e_level"), "h_level", "e_level", digits=4)


@query("cell_image_features")
def cell_image_features(t):
    """Shape and stain features of every user's polygon on images painted from order lines."""
    from tissuegrid.operators.cellimage import image_features
    from tissuegrid.sources.cells import tiles_from_pixels

    angle = 2 * math.pi * (F.col("event_id") % 12) / 12.0
    u = F.col("user_id")
    radius = 2 + 6 * F.col("value") / (F.col("value") + 100)
    at = t.events.groupBy(u.alias("cell_id"), (F.col("event_id") % 12).alias("seq")).agg(
        F.avg(radius * F.cos(angle) + 8 + u % 80).alias("x"), F.avg(radius * F.sin(angle) + 8 + u * 7 % 45).alias("y"))
    rings = ge.ring_arrays(at)
    shrunk = F.transform("polygon", lambda p: F.struct(
        (p["x"] * 0.5 + (8 + F.col("cell_id") % 80) * 0.5).alias("x"),
        (p["y"] * 0.5 + (8 + F.col("cell_id") * 7 % 45) * 0.5).alias("y")))
    images = F.array(F.lit("A"), F.lit("N"), F.lit("R"))
    cells = rings.select(F.element_at(images, (F.col("cell_id") % 3 + 1).cast("int")).alias("image_id"), "cell_id",
                         F.when(F.col("cell_id") % 5 > 0, F.col("polygon")).alias("cell_polygon"),
                         shrunk.alias("nucleus_polygon"))
    tiles = tiles_from_pixels(_pixels(t), 64)
    return image_features(cells, tiles, 64).select("cell_id", F.posexplode("features").alias("feature", "value")).transform(
        lambda d: rounded(d, "value", digits=4))
