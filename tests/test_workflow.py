"""The batch jobs from files to results on a small invented slide with a known answer."""

import json
import shutil
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuegrid.operators import cvae, gat
from tissuegrid.plans import state
from tissuegrid.plans import workflow as wf
from tissuegrid.sources.tables import read_csv

TYPES, GENES = ["A", "B", "C"], 30


@pytest.fixture(scope="module")
def slide(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    base = rng.dirichlet(np.full(GENES, 0.3), size=3)
    ref_counts, ref_types = [], []
    for c in range(90):
        y = rng.poisson(base[c % 3] * 2000)
        ref_types.append((c, TYPES[c % 3]))
        ref_counts += [(c, f"g{g}", float(v)) for g, v in enumerate(y) if v]
    spots, spot_counts, features, truth = [], [], [], {}
    for s in range(25):
        x, y = 100.0 * (s % 5), 100.0 * (s // 5)
        spots.append((s, x, y))
        kind = 0 if s % 5 < 2 else (1 if s % 5 < 4 else 2)
        total = np.zeros(GENES)
        for dx, dy in ((-15, 0), (15, 0), (0, 48)):
            truth[(x + dx, y + dy)] = TYPES[kind]
            ring = [[x + dx + 8 * np.cos(a), y + dy + 8 * np.sin(a)] for a in np.linspace(0, 2 * np.pi, 9)]
            features.append({"geometry": {"coordinates": [ring]}, "properties": {"measurements": {
                "Area": 200.0 + 5 * kind + rng.normal(), "Hue": rng.normal() + kind, **({"Rare": 1.0} if s % 7 == 0 else {})}}})
            if dy == 0:
                total += base[kind]
        counts = rng.poisson(total / 2 * 900)
        spot_counts += [(s, f"g{g}", float(v)) for g, v in enumerate(counts) if v]
    features.insert(0, {"geometry": {"coordinates": [[[0, 0], [1, 0], [1, 1]]]}, "properties": {}})
    path = tmp_path_factory.mktemp("slide") / "cells.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return {
        "geojson": str(path), "truth": truth,
        "spots": spark.createDataFrame(spots, "id long, x double, y double"),
        "counts": spark.createDataFrame(spot_counts, "id long, gene string, value double"),
        "ref": wf.Reference(spark.createDataFrame(ref_counts, "id long, gene string, value double"),
                            spark.createDataFrame(ref_types, "id long, cell_type string")),
    }


def test_whole_workflow(spark, slide, tmp_path):
    cells, features = wf.extract_features(spark, slide["geojson"], out=str(tmp_path))
    assert cells.count() == 75
    # The second feature of the file names the columns; its rare one is filled for the others.
    assert features.where("feature = 'Rare'").count() == 75
    assert features.where("value IS NULL").count() == 0
    radius = cells.agg(F.min("circumcircle"), F.max("circumcircle")).first()
    assert radius[0] == pytest.approx(8, abs=0.5) and radius[1] == pytest.approx(8, abs=0.5)

    spatial = wf.Spatial(slide["counts"], slide["spots"], diameter=60.0, cells=cells, features=features)
    settings = wf.Settings(adapt=False, all_genes=True, epochs=2, mcmc_iterations=2, umi_min_sigma=100, fill_rounds=6, n_neighbors=4)
    found = wf.identify_cells(spatial, slide["ref"], settings, out=str(tmp_path))
    assert found.all_labels.count() == 75
    at = {r["cell_id"]: (round(r["x"]), round(r["y"])) for r in cells.collect()}
    truth = {(round(k[0]), round(k[1])): v for k, v in slide["truth"].items()}
    rows = found.labels.collect()
    right = np.mean([truth[at[r["id"]]] == r["cell_type"] for r in rows])
    assert len(rows) >= 50 and right > 0.9
    everyone = np.mean([truth[at[r["id"]]] == r["cell_type"] for r in found.all_labels.collect()])
    assert everyone > 0.7

    # The kept result, and a run from the kept spot fit, give the same labels; other settings are refused.
    again = wf.identify_cells(spatial, slide["ref"], settings, out=str(tmp_path), resume=True)
    warm = state.load_warm(spark, f"{tmp_path}/warm")
    anew = wf.identify_cells(spatial, slide["ref"], settings, warm=warm)
    by_id = lambda d: sorted((r["id"], r["cell_type"]) for r in d.collect())
    assert by_id(found.all_labels) == by_id(again.all_labels) == by_id(anew.all_labels)
    assert np.array_equal(found.beta, again.beta) and found.sigma == again.sigma
    with pytest.raises(ValueError, match="nu"):
        wf.identify_cells(spatial, slide["ref"], replace(settings, nu=3.0), out=str(tmp_path), resume=True)
    written = read_csv(spark, f"{tmp_path}/labels_csv", "id string, cell_type string")
    assert by_id(written) == by_id(found.all_labels)
    effects = read_csv(spark, f"{tmp_path}/factors_csv", "feature string, gene string, value double")
    assert effects.count() == found.beta.size and np.isclose(effects.agg(F.sum("value")).first()[0], found.beta.sum())

    value = wf.enhance_from_spots(spatial, slide["ref"], again, k=10)
    assert value.select("id").distinct().count() == 75
    assert value.where("value < 0 OR value IS NULL").count() == 0


def test_adaptation_and_attention_fill(spark, slide, tmp_path, monkeypatch):
    cells, features = wf.extract_features(spark, slide["geojson"])
    spatial = wf.Spatial(slide["counts"], slide["spots"], diameter=60.0, cells=cells, features=features)
    settings = wf.Settings(
        adapt=True, all_genes=True, cvae=cvae.CvaeConfig(epochs=3, samples=200), epochs=1, mcmc_iterations=1, umi_min_sigma=100,
        fill="attention", gat=gat.GatConfig(hidden=8, epochs=3, block_nodes=40), neighbor_mode="knn", n_neighbors=4)
    found = wf.identify_cells(spatial, slide["ref"], settings, out=str(tmp_path / "a"))
    assert found.all_labels.count() == 75
    # A run that has the models but not the result takes them: nothing is trained again.
    for part in ("autoencoder", "attention"):
        shutil.copytree(tmp_path / "a" / part, tmp_path / "b" / part)
    monkeypatch.setattr(cvae, "train", None)
    monkeypatch.setattr(gat, "train", None)
    again = wf.identify_cells(spatial, slide["ref"], settings, out=str(tmp_path / "b"), resume=True)
    assert sorted(map(tuple, again.all_labels.collect())) == sorted(map(tuple, found.all_labels.collect()))
    kept = found.all_labels.join(found.labels.select("id", F.col("label").alias("own")), "id")
    assert kept.where("label <> own").count() == 0


def test_image_mode_enhancement_keeps_measured_genes(spark, slide):
    measured = slide["counts"].where("gene < 'g2'")
    axis = wf.impute.gene_axis(measured)
    config = cvae.CvaeConfig(epochs=2, samples=120)
    ref = slide["ref"]
    model, _, _ = cvae.adapt_domains(
        wf.nz.fraction_scale(measured), wf.nz.fraction_scale(ref.counts.join(axis, "gene", "left_semi").drop("ix")), axis, 3, config)
    labels = slide["spots"].select("id", F.when(F.col("x") < 150, "A").otherwise("unseen").alias("cell_type"))
    got = wf.enhance_from_image(wf.Spatial(measured, slide["spots"]), ref, labels, model, axis, k=8)
    kept = got.join(measured.withColumnRenamed("value", "raw"), ["id", "gene"])
    assert kept.count() == measured.count() and kept.where("value <> raw").count() == 0
    assert got.where("gene >= 'g2'").count() > 0 and got.where("value < 0").count() == 0


def test_transfer_between_sections(spark):
    rng = np.random.default_rng(2)
    rows, feats = [], []
    for i in range(90):
        kind = i % 2
        rows.append((i, i // 30, float(rng.normal() + 6 * kind), float(rng.normal()), float(i // 30), 0, kind))
        feats += [(i, "f1", float(kind + 0.1 * rng.normal())), (i, "f2", float(rng.normal()))]
    cells = spark.createDataFrame(rows, "id long, section int, x double, y double, z double, label int, cell_type int")
    features = spark.createDataFrame(feats, "id long, feature string, value double")
    out = wf.transfer_sections(cells, features, [0], {0: [1, 2]}, gat.GatConfig(hidden=8, epochs=12, lr=0.05, dropout=0.0, block_nodes=32), 2, 6)
    both = out.withColumnRenamed("label", "got").join(cells, "id")
    assert both.count() == 90 and both.where("got = cell_type").count() > 75
