"""Readers against files written here."""

import json

import numpy as np
import pandas as pd
import pytest

from tissuegrid.operators.cellimage import image_features
from tissuegrid.sources import cells as src
from tissuegrid.sources.tables import Tables, require_columns, write_table


def test_geojson_drops_malformed(spark, tmp_path):
    good = lambda x: {"geometry": {"coordinates": [[[x, 0], [x + 2, 0], [x + 2, 2]]]}, "properties": {"measurements": {"A": 1.0, "B": float(x)}}}
    doc = {"features": [{"geometry": {"coordinates": []}, "properties": {}}, good(0), {"properties": None}, good(5)]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    df = src.read_geojson(spark, str(tmp_path / "a.json"))
    assert df.count() == 2 and src.measurement_names(df) == ["A", "B"]
    late = good(9)
    late["properties"]["measurements"]["C"] = 2.0
    doc["features"].append(late)
    (tmp_path / "c.json").write_text(json.dumps(doc))
    assert src.measurement_names(src.read_geojson(spark, str(tmp_path / "c.json"))) == ["A", "B", "C"]
    named = src.number_cells(df, ["file", "pos"]).orderBy("cell_id").collect()
    assert [r["cell_id"] for r in named] == ["cell_0", "cell_1"] and named[1]["measurements"]["B"] == 5.0
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(good(i)) for i in range(3)))
    assert src.read_geojson(spark, str(tmp_path / "b.jsonl"), lines=True).count() == 3


def test_nuclei(spark, tmp_path):
    doc = {"nuc": {str(i): {"contour": [[10 + i, 11], [15, 13], [12, 19]], "centroid": [13.0, 15.0], "type": 1} for i in range(4)}}
    (tmp_path / "n.json").write_text(json.dumps(doc))
    df = src.read_nuclei(spark, str(tmp_path / "n.json"), 40, 20)
    row = df.where("nucleus_id = '1'").first()
    many = {"nuc": {str(i): doc["nuc"]["1"] for i in range(120_000)}}
    (tmp_path / "m.json").write_text(json.dumps(many))
    assert src.read_nuclei(spark, str(tmp_path / "m.json")).count() == 120_000
    assert 0.4 < src.read_nuclei(spark, str(tmp_path / "m.json"), share=0.5).count() / 120_000 < 0.6
    assert df.count() == 4 and row["contour"][0]["x"] == 5.0 and row["polygon"][0]["y"] == 5.5 and row["centroid"] == [6.0, 7.0]


def test_boundaries_keep_file_order_and_invert_alignment(spark, tmp_path):
    n = 50
    pd.DataFrame({"cell_id": [i // 5 for i in range(n)], "vertex_x": np.arange(n) * 2.0, "vertex_y": np.arange(n) * 1.0}).to_parquet(tmp_path / "b.parquet")
    df = src.read_boundaries(spark, str(tmp_path / "b.parquet"), [[1, 0, 4], [0, 1, -2], [0, 0, 1]], scale=2.0)
    rows = df.orderBy("seq").collect()
    assert [r["x"] for r in rows] == [i - 4.0 for i in range(n)] and rows[3]["y"] == 3.5
    pd.DataFrame({"cell_id": [1]}).to_parquet(tmp_path / "bad.parquet")
    with pytest.raises(ValueError, match="vertex_x"):
        src.read_boundaries(spark, str(tmp_path / "bad.parquet"))


@pytest.mark.parametrize("sep,name", [(",", "Detection Probability"), ("\t", "probability"), (",", "detection_prob")])
def test_probabilities(spark, tmp_path, sep, name):
    (tmp_path / "p.csv").write_text(f"Cell_ID{sep}{name}\n7{sep}0.25\n")
    probs = src.read_probabilities(spark, str(tmp_path / "p.csv"))
    cells = spark.createDataFrame([("7",), ("8",)], "cell_id string")
    assert {r[0]: r[1] for r in src.with_probability(cells, probs).collect()} == {"7": 0.25, "8": 1.0}
    (tmp_path / "q.csv").write_text("cell_id,other\n7,1\n")
    assert src.read_probabilities(spark, str(tmp_path / "q.csv")) is None


def test_find_slide(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "s1.tif").write_text("x")
    (tmp_path / "s2.svs").write_text("x")
    assert src.find_slide(spark, str(tmp_path), "s2").endswith("/s2.svs")
    assert src.find_slide(spark, str(tmp_path), "s1.svs").endswith("/sub/s1.tif")
    assert src.find_slide(spark, str(tmp_path), "nothing") is None


def test_tiles_and_cell_features_across_tile_borders(spark, tmp_path):
    rng = np.random.default_rng(0)
    img = rng.integers(80, 255, (70, 90, 3), dtype=np.uint8)
    img[20:45, 20:45] = (110, 60, 130)
    (tmp_path / "i.ppm").write_bytes(b"P6\n90 70\n255\n" + img.tobytes())
    ring = [{"x": float(32 + 9 * np.cos(a)), "y": float(32 + 9 * np.sin(a))} for a in np.linspace(0, 2 * np.pi, 12, endpoint=False)]
    cells = spark.createDataFrame([("i.ppm", "c1", ring, None), ("i.ppm", "c2", None, ring), ("i.ppm", "c3", ring, ring)],
                                  "image_id string, cell_id string, cell_polygon array<struct<x:double,y:double>>, nucleus_polygon array<struct<x:double,y:double>>")
    got = {}
    for size in (32, 128):
        tiles = src.read_tiles(spark, str(tmp_path / "i.ppm"), size)
        got[size] = {r["cell_id"]: r["features"] for r in image_features(cells, tiles, size).collect()}
    assert set(got[32]) == {"c1", "c2", "c3"} and got[32] == got[128]
    assert got[32]["c2"][0] > 0 and got[32]["c1"][0] == 0


def test_tables_and_sink(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert t.region.count() == 5
    write_table(t.region, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 5
    with pytest.raises(ValueError, match="nope"):
        require_columns(t.region, ["nope"], "region")
