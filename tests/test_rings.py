"""Ring nesting, the boundary pipeline and ranged JSON files against brute force."""

import json
import math
import random

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from tissuegrid.operators import rings as ri
from tissuegrid.plans import workflow as wf
from tissuegrid.sources import cells as src
from tissuegrid.sources import records


def _ring(cx, cy, r, n=8, turn=1, closed=False):
    pts = [(cx + r * math.cos(turn * 2 * math.pi * i / n), cy + r * math.sin(turn * 2 * math.pi * i / n)) for i in range(n)]
    return pts + pts[:1] if closed else pts


def _vertices(spark, outlines):
    rows = [(c, r, i, float(x), float(y)) for c, rings in outlines.items() for r, pts in rings.items() for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "cell_id string, ring long, seq long, x double, y double")


def _area(pts):
    return abs(sum(x1 * y2 - y1 * x2 for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]))) / 2


def _holds(pts, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
        if (y1 <= y) != (y2 <= y) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x:
            odd = not odd
    return odd


def _outlines():
    """Nested circles of random depth and direction, one cell with very many rings, one with a single ring."""
    rng = random.Random(4)
    out = {"single": {7: _ring(0, 0, 3)}, "deep": {i: _ring(0, 0, 1 + i, turn=(-1) ** i, closed=i % 3 == 0) for i in range(40)},
           "wide": {i: _ring(10 * (i % 20), 10 * (i // 20), 4 if i % 2 else 1.5) for i in range(300)}}
    out["wide"] |= {1000: [(-20, -20), (220, -20), (220, 170), (-20, 170)]}
    for c in range(20):
        out[f"c{c}"] = {}
        for _ in range(rng.randint(2, 9)):
            k, level = rng.randrange(3), rng.randint(1, 6)
            out[f"c{c}"][10 * k + level] = _ring(100 * k, rng.random(), level * 5, n=rng.randint(12, 20), turn=rng.choice([1, -1]))
    return out


@pytest.mark.parametrize("strip_edges", [4, 256])
def test_nesting_equals_brute_force(spark, strip_edges):
    outlines = _outlines()
    edges = ri.ring_edges(_vertices(spark, outlines))
    got = {(r.cell_id, r.ring): (r.depth, r.parent, r.part, r.hole) for r in ri.nest(edges, ri.ring_sums(edges), strip_edges).collect()}
    want = {}
    for c, rings in outlines.items():
        for r, pts in rings.items():
            x, y = ((pts[0][i] + pts[1][i]) / 2 for i in (0, 1))
            around = [o for o, other in rings.items() if o != r and _holds(other, x, y)]
            parent = min(around, key=lambda o: (_area(rings[o]), o), default=None)
            hole = len(around) % 2 == 1
            want[c, r] = (len(around), parent, parent if hole else r, hole)
    assert got == want


def test_largest_part_without_its_holes(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    outlines = {
        # The larger square loses most of its area to a hole.
        "a": {0: square(0, 0, 10), 1: square(0.5, 0.5, 9)[::-1], 2: square(100, 0, 8)},
        # The hole is off centre and moves the centroid.
        "b": {3: square(0, 0, 4) + [(0, 0)], 4: square(2, 2, 1)},
        # Equal parts: the least ring number counts. A ring without area and one of two points go.
        "c": {5: square(9, 9, 2), 2: square(0, 0, 2), 1: [(0, 0), (1, 1), (2, 2)], 0: [(0, 0), (9, 9)]},
        "d": {0: [(0, 0), (1, 1)]},
    }
    v = _vertices(spark, outlines)
    m = ri.outline_measures(v)
    got = {r.cell_id: r for r in m.collect()}
    assert set(got) == {"a", "b", "c"}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.ring, a.area, a.n_parts, a.n_holes, a.total_area) == (2, 64, 2, 1, 83) and (a.centroid_x, a.centroid_y) == (104, 4)
    assert a.radius == pytest.approx(4 * math.sqrt(2))
    cx = (16 * 2 - 1 * 2.5) / 15
    assert b.area == 15 and b.perimeter == 20 and b.centroid_x == pytest.approx(cx) and b.radius == pytest.approx(math.hypot(cx, cx) if cx > 2 else math.hypot(4 - cx, 4 - cx))
    assert (c.ring, c.n_parts, c.area) == (2, 2, 4)
    polygons = {r.cell_id: [(p.x, p.y) for p in r.polygon] for r in ri.outside_rings(v, m).collect()}
    assert polygons["b"] == square(0, 0, 4) and polygons["a"] == square(100, 0, 8)


def test_boundary_files_become_one_table(spark, tmp_path):
    def rows(cell, ring, pts):
        return [(cell, ring, 2 * x + 8, 2 * y - 4) for x, y in pts]

    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    columns = ["cell_id", "label", "vertex_x", "vertex_y"]
    cells = rows("a", 1, square(0, 0, 10)) + rows("a", 2, square(1, 1, 2)) + rows("a", 3, square(50, 0, 3)) + rows("c", 1, square(7, 7, 2))
    nuclei = rows("a", 1, square(4, 4, 4)) + rows("b", 1, square(20, 20, 6))
    pd.DataFrame(cells, columns=columns).to_parquet(tmp_path / "cells.parquet")
    pd.DataFrame(nuclei, columns=columns).to_parquet(tmp_path / "nuclei.parquet")
    (tmp_path / "p.csv").write_text("Cell ID,Probability\na,0.75\n")
    got = wf.extract_boundaries(
        spark, str(tmp_path / "cells.parquet"), str(tmp_path / "nuclei.parquet"), str(tmp_path / "p.csv"),
        alignment=[[1, 0, 4], [0, 1, -2], [0, 0, 1]], scale=2.0, ring="label", out=str(tmp_path / "out"))
    r = {x.cell_id: x for x in got.collect()}
    assert set(r) == {"a", "b", "c"}
    assert (r["a"].cell_area, r["a"].cell_total_area, r["a"].cell_n_parts, r["a"].cell_n_holes) == (96, 105, 2, 1)
    assert r["a"].nucleus_cell_ratio == pytest.approx(16 / 96) and r["a"].probability == 0.75
    assert r["b"].cell_area is None and r["b"].nucleus_cell_ratio == 0 and (r["b"].x, r["b"].y, r["b"].probability) == (23, 23, 1)
    assert r["c"].nucleus_area is None and r["c"].circumcircle == pytest.approx(math.sqrt(2))
    assert r["c"].polygon == "[(7.0,7.0),(9.0,7.0),(9.0,9.0),(7.0,9.0)]"
    file = next((tmp_path / "out" / "boundaries").glob("*.parquet"))
    assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "ZSTD"


# Ranged files --------------------------------------------------------------------------------


def _nasty(rng):
    return "".join(rng.choices('{}[]"\\:, abé\n', k=rng.randint(0, 30)))


def _states(path, size, step):
    inside, depth, out = False, 0, []
    for a in range(0, size, step):
        out.append(records.JsonRange(path, a, min(a + step, size), inside, depth))
        texts, *net = records.changes(out[-1])
        depth += net[inside]
        inside ^= bool(texts)
    assert (inside, depth) == (False, 0)
    return out


@pytest.mark.parametrize("step,block", [(10 ** 6, 1 << 20), (1000, 64), (41, 1 << 20), (7, 5)])
@pytest.mark.parametrize("indent", [None, 1])
def test_ranges_give_every_record_once(tmp_path, monkeypatch, step, block, indent):
    monkeypatch.setattr(records, "BLOCK", block)
    rng = random.Random(3)
    entry = lambda i: {"id": _nasty(rng), "geometry": {"c": [[i, [0]], []]}, "p": {"n": _nasty(rng), "m": {"a": 1.0}}}
    listed = [entry(i) for i in range(60)]
    named = {f"{_nasty(rng)}{i}": entry(i) for i in range(60)} | {"long" * 600: entry(0)}
    for doc, level, keyed in (({"crs": {"p": {"n": _nasty(rng)}}, "box": [1, 2], "features": listed}, 2, False),
                              ({"mag": 40, "nuc": named}, 2, True), (listed, 1, False)):
        text = json.dumps(doc, indent=indent, ensure_ascii=False)
        (tmp_path / "f.json").write_text(text)
        path = str(tmp_path / "f.json")
        got = [(n, json.loads(r)) for p in _states(path, len(text.encode()), step) for _, _, n, r in records.records(p, level, keyed)]
        got = [(n, r) for n, r in got if "geometry" in r]
        assert got == ([*named.items()] if keyed else [(None, r) for r in listed])


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    feature = lambda i: {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[i, 0], [i + 2, 0], [i + 2, 2], [i, 0]]]},
                         "properties": {"name": 'cell "}{" \\', "measurements": {"A": float(i)}}}
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(i) for i in range(500)]}))
    path = str(tmp_path / "a.json")
    size = (tmp_path / "a.json").stat().st_size
    one = src.read_geojson(spark, path)
    many = src.read_geojson(spark, path, range_bytes=-(-size // 16))
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 16
    a, b = ([r.asDict(recursive=True) for r in x.orderBy("pos").collect()] for x in (one, many))
    assert len(a) == 500 and a == b and [r["measurements"]["A"] for r in b] == list(map(float, range(500)))


def test_parts_of_a_multipolygon_reach_the_features(spark, tmp_path):
    square = lambda x, s: [[x, 0], [x + s, 0], [x + s, s], [x, s], [x, 0]]
    shape = lambda kind, c, a: {"geometry": {"type": kind, "coordinates": c}, "properties": {"measurements": {"A": a}}}
    doc = {"features": [
        shape("MultiPolygon", [[square(0, 10), square(1, 9)[::-1]], [square(100, 8)]], 1.0), shape("Polygon", [square(50, 2)], 2.0),
        shape("MultiPolygon", [[square(200, 4)], [square(300, 2)]], 3.0), shape("Polygon", "broken", 4.0)]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    cells, features = wf.extract_features(spark, str(tmp_path / "m.json"))
    got = {r.cell_id: (r.x, r.y, round(r.circumcircle, 6), len(r.polygon)) for r in cells.collect()}
    # The hole leaves 19 of the first square's 100, so the second square is the larger part.
    assert got == {"cell_0": (104, 4, round(4 * math.sqrt(2), 6), 4), "cell_1": (51, 1, round(math.sqrt(2), 6), 5),
                   "cell_2": (202, 2, round(2 * math.sqrt(2), 6), 4)}
    assert {r.value for r in features.where("feature = 'A'").collect()} == {1.0, 2.0, 3.0}
    assert np.isclose(features.where("feature = 'Circumcircle' AND id = 'cell_2'").first().value, 2 * math.sqrt(2))
