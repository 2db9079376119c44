"""Hand-computed fixtures, properties and brute-force checks of single operators."""

import inspect
import json
import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tissuegrid.functions import likelihood as lk
from tissuegrid.functions import scalars as fx
from tissuegrid.operators import assign as asg
from tissuegrid.operators import cellimage as ci
from tissuegrid.operators import classify as cf
from tissuegrid.operators import cvae, deconv, gat
from tissuegrid.operators import geometry as ge
from tissuegrid.operators import graph as gr
from tissuegrid.operators import impute as im
from tissuegrid.operators import matrix as mx
from tissuegrid.operators import metrics as mt
from tissuegrid.operators import normalize as nz
from tissuegrid.operators import propagate as lp
from tissuegrid.operators import ranking as rk
from tissuegrid.operators import registration as rg
from tissuegrid.operators import sampling as sm
from tissuegrid.operators import spots as sp
from tissuegrid.operators import training as tr
from tissuegrid.plans import catalog
from tissuegrid.session import materialize


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- matrices ----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def counts(spark):
    data = [("c1", "g1", 4.0), ("c1", "g2", 6.0), ("c2", "g1", 5.0), ("c3", "mt-1", 8.0), ("c3", "g2", 2.0), ("c4", "g3", 1.0)]
    return spark.createDataFrame(data, "id string, gene string, value double")


@pytest.fixture(scope="module")
def types(spark):
    return spark.createDataFrame([("c1", "A"), ("c2", "A"), ("c3", "B"), ("c4", "B")], "id string, cell_type string")


def test_profiles_count_zeros(counts, types):
    got = {(r[0], r[1]): r[2] for r in mx.type_profiles(counts, types).collect()}
    assert got[("g1", "A")] == pytest.approx((0.4 + 1.0) / 2)
    assert got[("g2", "A")] == pytest.approx(0.3) and got[("g2", "B")] == pytest.approx(0.1)
    assert got[("mt-1", "B")] == pytest.approx(0.4)


def test_markers_skip_mitochondrial_and_rare_genes(spark, counts, types):
    bulk = spark.createDataFrame([("g1", 10.0), ("mt-1", 10.0), ("g2", 2.0), ("g3", 9.0)], "gene string, total double")
    found = mx.marker_genes(mx.type_profiles(counts, types), bulk, 2, fold=1.0, expression=1e-4, min_obs=3)
    assert {(r["gene"], r["cell_type"]) for r in found.collect()} == {("g1", "A"), ("g3", "B")}


def test_barcode_check(spark, counts):
    coords = counts.select("id").distinct()
    mx.check_barcodes(coords, counts, mx.library_sizes(counts))
    with pytest.raises(ValueError, match="same ids"):
        mx.check_barcodes(coords.where("id <> 'c1'"), counts, mx.library_sizes(counts))
    with pytest.raises(ValueError, match="share no id"):
        mx.check_barcodes(spark.createDataFrame([("x",)], "id string"), counts, mx.library_sizes(counts))


def test_keep_top_share_breaks_ties_once(spark):
    data = spark.createDataFrame([(i, j, 1.0 + (i == 0)) for i in range(4) for j in range(5)], "id long, gene long, value double")
    kept = mx.keep_top_share(data, 5, 4)
    assert kept.count() == 11 and kept.where("value = 2").count() == 5


def test_mean_fill_and_constant_scores(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (2, "a", float("nan")), (3, "a", 3.0), (1, "b", 5.0), (2, "b", None), (3, "b", 5.0)],
                                 "id long, feature string, value double")
    filled = mx.mean_fill(long)
    assert rows(filled.where("id = 2").select("feature", "value")) == [("a", 2.0), ("b", 5.0)]
    scaled = {(r[0], r[1]): r[2] for r in nz.standardize(filled).collect()}
    assert scaled[(1, "b")] == 0 and scaled[(3, "a")] == pytest.approx(1 / math.sqrt(2 / 3))


def test_gene_zscore_matches_dense(spark):
    rng = np.random.default_rng(0)
    dense = rng.poisson(1.0, (12, 4)).astype(float)
    dense[:, 3] = 2.0
    df = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(12) for j in range(4) if dense[i, j]], "id long, gene long, value double")
    z = (dense - dense.mean(0)) / np.where(dense.std(0) > 0, dense.std(0), np.nan)
    for r in nz.gene_zscore(df, F.lit(12)).collect():
        want = z[r["id"], r["gene"]]
        assert r["z"] is None if np.isnan(want) else r["z"] == pytest.approx(want, abs=1e-9)
    v = {r["id"]: r["v"] for r in im.zscore_vectors(df, im.gene_axis(df)).collect()}
    for i, row in v.items():
        assert np.allclose(row, np.nan_to_num(z[i]), atol=1e-9)


def test_unlog_heuristic(spark):
    df = spark.createDataFrame([(1, "g", math.log(8.0)), (2, "g", 0.0)], "id long, gene string, value double")
    assert [round(r[2], 9) for r in nz.unlog_if_log_scale(df).orderBy("id").collect()] == [7.0, 0.0]
    raw = spark.createDataFrame([(1, "g", 31.0)], "id long, gene string, value double")
    assert nz.unlog_if_log_scale(raw).first()[2] == 31.0


# ---- order statistics ----------------------------------------------------------------------------

@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 5)), min_size=1, max_size=40), st.floats(0, 1))
def test_quantiles_match_numpy(spark, data, p):
    df = spark.createDataFrame([(k, float(v)) for k, v in data], "k string, v double")
    got = {r["k"]: r["q"] for r in rk.quantiles(df, "v", {"q": p}, ["k"]).collect()}
    for k in {k for k, _ in data}:
        assert got[k] == pytest.approx(np.quantile([v for key, v in data if key == k], p), abs=1e-9)


def test_running_sum_over_a_dominant_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rk.row_numbers(df, [F.col("id")], "rn", ["k"])
        hot = got.where("k = 0").orderBy("id").collect()
        assert got.rdd.getNumPartitions() > 1 and [r["rn"] for r in hot] == list(range(1, len(hot) + 1))
        assert got.where("k > 0").agg(F.max("rn")).first()[0] == 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_sampling_ignores_partitioning(spark):
    types = spark.range(300).select("id", (F.col("id") % 4 > 0).cast("string").alias("cell_type"))
    a = rows(sm.sample_per_class(types.repartition(1), 20, 3).select("id"))
    assert a == rows(sm.sample_per_class(types.repartition(9), 20, 3).select("id")) and len(a) == 40
    assert a != rows(sm.sample_per_class(types, 20, 4).select("id"))


def test_farthest_points_compare_only_what_a_pick_can_change(spark):
    """Clouds of unequal density with copies; a pass takes a share of the points, so passes do not grow with the table."""
    assert [sm.batch_rows(n) for n in (100, 100_000, 10_000_000)] == [4096, 12_500, 65_536]
    rng = np.random.default_rng(8)
    for dim in (1, 3):
        v = np.vstack([rng.normal(size=(60, dim)), 50 + 1e-3 * rng.normal(size=(60, dim)), np.full((10, dim), -4.0)])
        df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(v)], "id long, v array<double>")
        gap, want = np.full(len(v), np.inf), [0]
        while len(want) < 100:
            gap = np.minimum(gap, np.sqrt(((v - v[want[-1]]) ** 2).sum(1)))
            want.append(int(gap.argmax()))
        for batch in (40, None):
            assert [r["id"] for r in sm.farthest_points(df, 100, batch).orderBy("pick").collect()] == want


def test_farthest_points_in_small_batches(spark):
    rng = np.random.default_rng(1)
    xy = rng.random((60, 2))
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(xy)], "id long, v array<double>")
    picks, gap = [0], np.linalg.norm(xy - xy[0], axis=1)
    while len(picks) < 48:
        picks.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(xy - xy[picks[-1]], axis=1))
    for batch in (5, 4096):
        got = [r["id"] for r in sm.farthest_points(df, 48, batch).orderBy("pick").collect()]
        assert got == picks


def test_mixture_weights(spark):
    ones = spark.createDataFrame([(i, "g", 1.0) for i in range(10)], "id long, gene string, value double")
    mixed = sm.random_mix(ones, spark.range(50).withColumnRenamed("id", "mix_id"), 8, 2)
    assert mixed.count() == 50 and mixed.where("abs(value - 1) > 1e-9").count() == 0


# ---- metrics ---------------------------------------------------------------------------------

def _pairs(spark, data):
    return spark.createDataFrame(data, "y_true string, y_pred string")


def test_metrics_on_known_pairs(spark):
    same = _pairs(spark, [("a", "a")] * 3 + [("b", "b")] * 2)
    swapped = _pairs(spark, [("a", "b")] * 3 + [("b", "a")] * 2)
    single = _pairs(spark, [("a", "a")] * 4)
    for p in (same, swapped):
        assert mt.adjusted_rand(p).first()[0] == pytest.approx(1) and mt.normalized_mutual_info(p).first()[0] == pytest.approx(1)
        assert mt.purity(p).first()[0] == 1
    assert mt.accuracy(same).first()[0] == 1 and mt.accuracy(swapped).first()[0] == 0 and mt.macro_f1(swapped).first()[0] == 0
    assert mt.adjusted_rand(single).first()[0] == 1 and mt.normalized_mutual_info(single).first()[0] == 1
    # Hand-computed: contingency (2, 1 / 1, 2).
    mixed = _pairs(spark, [("a", "a")] * 2 + [("a", "b")] + [("b", "a")] + [("b", "b")] * 2)
    assert mt.adjusted_rand(mixed).first()[0] == pytest.approx((2 - 2.4) / (6 - 2.4))
    assert mt.macro_f1(mixed).first()[0] == pytest.approx(2 / 3)


def test_background_domain_counts_per_label(spark):
    cells = spark.createDataFrame([("x", "D", 1.0), ("x", "E", 0.5), ("n", "D", 1.0), ("m", "E", 1.0)], "label string, region string, weight double")
    domains = spark.createDataFrame([("D", "x"), ("None", "n"), ("None", "m")], "domain string, label string")
    want = np.mean([1.0 / 1.5, 1 - 1 / 4, 1 - 1 / 4])
    assert mt.enrichment(cells, domains).first()[0] == pytest.approx(want)


# ---- graph and imputation ------------------------------------------------------------------------

def test_chain_propagation(spark):
    edges = gr.symmetric(spark.createDataFrame([(i, i + 1) for i in range(4)], "src long, dst long"))
    labels = spark.createDataFrame([(0, 0), (4, 1)], "id long, label long")
    free = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    classes = spark.range(2).withColumnRenamed("id", "label")
    mass = lp.one_hot_mass(labels).unionByName(lp.uniform_mass(free, classes))
    done = lp.propagate(edges, mass, 9, labels)
    p = {(r["id"], r["label"]): r["p"] for r in done.collect()}
    assert p[(0, 0)] == 1 and p[(4, 1)] == 1 and p[(1, 0)] > 0.5 and p[(3, 1)] > 0.5
    assert p[(2, 0)] == pytest.approx(p[(2, 1)])
    for node in range(5):
        assert sum(v for (i, _), v in p.items() if i == node) == pytest.approx(1)
    assert dict(rows(lp.top_label(done)))[2] == 0


def test_neighbor_weight_rule(spark):
    near = [(1, 10, 0.2, 1), (1, 11, 0.3, 2), (1, 12, 1.2, 3), (2, 10, 0.4, 1), (2, 11, 1.0, 2), (3, 10, 0.0, 1), (3, 11, 0.0, 2),
            (4, 10, 1.5, 1), (4, 11, 1.6, 2)]
    df = spark.createDataFrame(near, "query_id long, ref_id long, distance double, rank long")
    w = {(r[0], r[1]): r[2] for r in im.neighbor_weights(df).collect()}
    assert w == {(1, 10): pytest.approx(0.6), (1, 11): pytest.approx(0.4), (2, 10): 1.0, (3, 10): 0.5, (3, 11): 0.5, (4, 10): 1.0}
    assert {r[0] for r in im.neighbor_weights(df, lone="zero").collect()} == {1, 3}


@pytest.mark.parametrize("dropout", [0.0, 0.2])
def test_attention_blocks_equal_whole_graph(spark, dropout):
    rng = np.random.default_rng(3)
    n = 40
    nodes = spark.createDataFrame(
        [(i, i, [float(x) for x in rng.normal(size=4)], int(i % 3) if i % 2 else None) for i in range(n)],
        "id long, order long, v array<double>, label int")
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, n, (120, 2)) if a != b}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    c = gat.GatConfig(hidden=6, dropout=dropout, epochs=3 if dropout == 0 else 8)
    out = {}
    for size in (7, 1000):
        blocks = gat.graph_blocks(nodes, edges, size)
        params, losses = gat.train(blocks, 3, c)
        out[size] = (losses, {r["id"]: r["score"] for r in gat.predict(blocks, params).collect()})
    assert out[7][0] == pytest.approx(out[1000][0]) and out[7][1] == pytest.approx(out[1000][1])
    assert out[7][0][-1] < out[7][0][0]


# ---- geometry ------------------------------------------------------------------------------------

def _rings(spark, polygons):
    data = [(k, i, float(x), float(y)) for k, ring in polygons.items() for i, (x, y) in enumerate(ring)]
    return spark.createDataFrame(data, "cell_id string, seq int, x double, y double")


def test_squares_and_rejection(spark):
    v = _rings(spark, {"open": [(0, 0), (2, 0), (2, 2), (0, 2)], "closed": [(5, 5), (9, 5), (9, 9), (5, 9), (5, 5)], "bad": [(0, 0), (1, 1)]})
    edges = ge.ring_edges(v)
    m = {r["cell_id"]: r for r in ge.ring_measures(edges).collect()}
    assert set(m) == {"open", "closed"} and m["open"]["area"] == 4 and m["closed"]["area"] == 16
    assert (m["closed"]["centroid_x"], m["closed"]["centroid_y"]) == (7, 7) and m["open"]["perimeter"] == 8
    r = dict(rows(ge.ring_radius(edges, ge.ring_measures(edges))))
    assert r["open"] == pytest.approx(math.sqrt(2)) and r["closed"] == pytest.approx(math.sqrt(8))
    assert rows(ge.rejected_rings(v)) == [("bad", 2)]


def test_circle_overlap_cases(spark):
    polygons = {"inside": [(-1, -1), (1, -1), (1, 1), (-1, 1)], "outside": [(50, 50), (51, 50), (51, 51), (50, 51)],
                "half": [(0, -20), (40, -20), (40, 20), (0, 20)], "around": [(-30, -30), (30, -30), (30, 30), (-30, 30)],
                "clockwise": [(-1, 1), (1, 1), (1, -1), (-1, -1)]}
    edges = ge.ring_edges(_rings(spark, polygons))
    circles = spark.createDataFrame([(1, k, 0.0, 0.0, 10.0) for k in polygons], "spot_id int, cell_id string, cx double, cy double, r double")
    got = {r["cell_id"]: r["frac"] for r in ge.circle_overlap(edges, circles).collect()}
    assert got["inside"] == pytest.approx(1) and got["clockwise"] == pytest.approx(1) and got["outside"] == pytest.approx(0, abs=1e-12)
    assert got["half"] == pytest.approx(math.pi * 50 / 1600) and got["around"] == pytest.approx(math.pi * 100 / 3600)


def test_polygons_beside_or_around_a_circle_share_exactly_nothing_or_all_of_it(spark):
    """Angles seen from the circle's centre sum to a hair beside zero in floating point."""
    rng = np.random.default_rng(4)
    star = lambda x, y, size: [(x + size * (1 + rng.random()) * math.cos(a), y + size * (1 + rng.random()) * math.sin(a))
                               for a in np.arange(37) * 2 * math.pi / 37]
    polygons = {f"beside{i}": star(60.0, 7.0 + i / 3, 20.0) for i in range(20)}
    polygons["around"] = [(-30, -30), (30, -30), (30, 30), (-30, 30)]
    edges = ge.ring_edges(_rings(spark, polygons))
    circles = spark.createDataFrame([(1, k, 0.0, 0.0, 10.0) for k in polygons], "spot_id int, cell_id string, cx double, cy double, r double")
    got = {r["cell_id"]: r["frac"] for r in ge.circle_overlap(edges, circles).collect()}
    assert len(got) == 21 and got.pop("around") == math.pi * 100 / 3600
    assert set(got.values()) == {0.0}


def test_spot_boundary_and_tie(spark):
    spots = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0)], "spot_id int, x double, y double")
    cells = spark.createDataFrame([("tie", 5.0, 0.0, 1.0), ("edge", -5.0, 0.0, 1.0), ("far", -5.1, 0.0, 1.0)], "cell_id string, x double, y double, radius double")
    got = rows(sp.nearest_spots(cells, spots, 8.0).select("cell_id", "spot_id"))
    assert got == [("edge", 1), ("tie", 1), ("tie", 2)]


def test_hull_features_of_a_crowd(spark):
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(9000, 2))
    df = spark.createDataFrame([("c", float(x), float(y)) for x, y in pts], "cell_id string, x double, y double")
    got = ge.shape_features(df).first()
    hull = ge._hull(pts)
    want = max(np.linalg.norm(hull - p, axis=1).max() for p in hull)
    assert got["area"] == 9000 and got["max_diameter"] == pytest.approx(want)
    inside = ge.inside_hull(df.limit(50).withColumnRenamed("cell_id", "id"), df)
    assert inside.count() == 50


def test_hulls_merge_in_levels(spark, monkeypatch):
    """Many chunks per key, merged three at a time; a key of one point and one of points in a row."""
    monkeypatch.setattr(ge, "HULL_CHUNK", 20)
    monkeypatch.setattr(ge, "HULL_FAN", 3)
    rng = np.random.default_rng(6)
    pts = rng.normal(size=(1500, 2))
    data = [("c", float(x), float(y)) for x, y in pts] + [("one", 1.0, 2.0)] + [("row", float(i), 0.0) for i in range(5)]
    df = spark.createDataFrame(data, "cell_id string, x double, y double")
    got = {r["cell_id"]: r for r in ge.hull_points(df).collect()}
    assert np.allclose([(p["x"], p["y"]) for p in got["c"]["hull"]], ge._hull(pts))
    assert len(got["one"]["hull"]) == 1 and len(got["row"]["hull"]) == 2 and got["c"]["n_points"] == 1500
    wide = {r["cell_id"]: r["max_diameter"] for r in ge.shape_features(df).collect()}
    hull = ge._hull(pts)
    assert wide["c"] == pytest.approx(max(np.linalg.norm(hull - p, axis=1).max() for p in hull))
    assert wide["one"] == 0 and wide["row"] == 4


def test_diameter_of_hulls():
    rng = np.random.default_rng(7)
    shapes = [rng.normal(size=(n, 2)) * s for n in (3, 4, 5, 9, 40, 300) for s in ((1, 1), (1, 0.01), (1e-3, 50))]
    shapes += [np.array(b, float) for b in ([(0, 0), (2, 0), (2, 1), (0, 1)], [(0, 0), (1, 0)], [(0, 0)],
                                            [(0, 0), (4, 0), (4, 3), (0, 3), (2, 5), (2, -2)])]
    shapes += [np.round(rng.normal(size=(60, 2)) * 3) for _ in range(20)]
    for p in shapes:
        hull = ge._hull(p)
        want = max(np.linalg.norm(hull - c, axis=1).max() for c in hull)
        assert ge._diameter(hull) == pytest.approx(want, rel=1e-12), p
    turn = np.arange(100_000) * 2 * np.pi / 100_000
    assert ge._diameter(np.column_stack([np.cos(turn), np.sin(turn)])) == pytest.approx(2, rel=1e-9)


def test_hull_of_a_circle_of_many_corners(spark):
    at = F.col("id") * (2 * math.pi / 100_000)
    ring = spark.range(100_000).select(F.lit("c").alias("cell_id"), (1000 * F.cos(at)).alias("x"), (1000 * F.sin(at)).alias("y"))
    got = ge.shape_features(ring).first()
    assert got["max_diameter"] == pytest.approx(2000, rel=1e-8) and got["solidity"] == pytest.approx(1e5 / (math.pi * 1e6), rel=1e-6)


def test_tissue_patches(spark):
    cells = spark.createDataFrame([(1, 255.5, 10.0), (2, 254.5, 10.0), (3, -0.4, 0.0), (4, 700.0, 700.0), (5, 300.0, 300.0)], "id int, x double, y double")
    patches = spark.createDataFrame([(0, 0), (200, 200), (200, 200)], "x int, y int")
    # 255.5 rounds half to even, to 256, outside the first square.
    assert [r[0] for r in rows(ge.in_tissue(cells, patches).select("id"))] == [2, 3, 5]
    assert ge.in_tissue(cells, None).count() == 5


def test_rigid_fit_recovers_motion_without_reflection(spark):
    rng = np.random.default_rng(6)
    for axes, rot in ((["x", "y"], np.array([[0.6, -0.8], [0.8, 0.6]])), (["x", "y", "z"], np.linalg.qr(rng.normal(size=(3, 3)))[0])):
        if np.linalg.det(rot) < 0:
            rot[:, 0] *= -1
        a = rng.normal(size=(30, len(axes)))
        b = a @ rot.T + 3
        df = spark.createDataFrame([tuple(map(float, [*p, *q])) for p, q in zip(a, b)], [f"a_{x}" for x in axes] + [f"b_{x}" for x in axes])
        got, shift = rg.rigid_transform(df, axes)
        assert np.allclose(got, rot) and np.allclose(shift, 3)


def test_masks_of_a_disc():
    a = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    mask = ci.fill_polygon(20 + 8 * np.cos(a), 20 + 8 * np.sin(a), 41, 41)
    area, length, circ, solid, wide, narrow = ci.mask_shape(mask)
    assert area == pytest.approx(math.pi * 64, rel=0.05) and wide == pytest.approx(16, rel=0.05) and narrow == pytest.approx(16, rel=0.05)
    assert 0.7 < circ < 1.3 and solid > 0.9
    disc = ci.ellipse_offsets(3)
    assert (ci.erode(mask, disc) <= mask).all() and (mask <= ci.dilate(mask, disc)).all()
    rgb = np.full((41, 41, 3), 230, np.uint8)
    rgb[mask] = (120, 60, 140)
    row = ci.boundary_features(rgb, np.column_stack([20 + 8 * np.cos(a), 20 + 8 * np.sin(a)]), None)
    assert len(row) == 53
    assert len(ci.contour_features(rgb, np.column_stack([20 + 8 * np.cos(a), 20 + 8 * np.sin(a)]))) == 78


# ---- text ----------------------------------------------------------------------------------------

def test_natural_order_and_polygon_text(spark):
    names = spark.createDataFrame([("g2",), ("g10",), ("g1a",), ("2x",), ("g1",), ("g02",)], "name string")
    order = [r[0] for r in names.orderBy(fx.natural_key(F.col("name")), "name").collect()]
    assert order == ["2x", "g1", "g1a", "g02", "g2", "g10"]
    df = spark.createDataFrame([("[(1.5,2.0), (3.0,4.0)]",), ("nonsense",)], "s string").select(fx.parse_polygon(F.col("s")).alias("p"))
    got = [r["p"] for r in df.collect()]
    assert [(p["x"], p["y"]) for p in got[0]] == [(1.5, 2.0), (3.0, 4.0)] and got[1] is None
    back = df.select(fx.polygon_text(F.col("p"))).collect()
    assert back[0][0] == "[(1.5,2.0),(3.0,4.0)]" and back[1][0] == ""


def test_classifier(spark):
    doc = {"featureExtractor": {"featureExtractor": {"measurements": ["a", "b"]}, "normalizer": {"offsets": [0.0, 1.0], "scales": [1.0, 2.0], "missingValue": 0.0}},
           "classifier": {"statmodel": {"layer_sizes": [2, 2], "activation_function": "SIGMOID_SYM", "f_param1": 1.0, "f_param2": 1.0,
                                        "input_scale": [2.0, 0.5, 1.0, -1.0], "weights": [[1.0, -1.0, 0.5, 0.25, 0.1, 0.2]]}},
           "pathClasses": [{"name": "P"}, {"name": "Q"}]}
    df = spark.createDataFrame([(1, "a", 0.3), (1, "b", 0.7), (2, "a", -2.0), (2, "b", None)], "id int, feature string, value double")
    got = {r["id"]: r for r in cf.classify(df, cf.load_classifier(json.dumps(doc))).collect()}
    for i, a, b in ((1, 0.3, 0.7), (2, -2.0, 0.0)):
        x = np.array([a * 2 + 0.5, (b + 1) * 2 - 1])
        s = x @ np.array([[1, -1], [0.5, 0.25]]) + np.array([0.1, 0.2])
        f = (1 - np.exp(-s)) / (1 + np.exp(-s))
        assert got[i]["label"] == "PQ"[f.argmax()] and got[i]["score"] == pytest.approx(f.max())


# ---- deconvolution and assignment ------------------------------------------------------------------

def test_likelihood_table_is_a_distribution():
    grid, table = lk.rate_grid(), lk.count_table(30)
    assert table.shape == (lk.N_COUNTS, lk.N_RATES) and (np.diff(grid) > 0).all()
    low = int(np.searchsorted(grid, 5.0))
    assert table[:, low].sum() == pytest.approx(1, abs=1e-6)
    x, y, h = np.array([0.3, 2.0, 9.0]), np.array([0, 3, 7]), 1e-4
    f = lambda v: np.log(lk.probability(v, y, table, grid))
    d1, _ = lk.log_derivatives(x, y, table, grid)
    assert np.allclose(d1, (f(x + h) - f(x - h)) / (2 * h), atol=0.03)


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 7), st.integers(0, 10_000))
def test_quadratic_programme_meets_its_conditions(n, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(9, n, n))
    d, c = a @ a.transpose(0, 2, 1) + 1e-3 * np.eye(n), rng.normal(size=(9, n))
    c[0] = -1  # nothing above zero
    us, settled = deconv.stacked_nonnegative(d, c)
    assert settled.all()
    for u, di, ci in zip(us, d, c):
        slope = di @ u - ci
        assert (u >= 0).all() and (slope > -1e-7).all() and abs(slope @ u) < 1e-7


@pytest.mark.parametrize("constrain", [False, True])
def test_spots_fit_alike_alone_and_in_a_stack(constrain, monkeypatch):
    rng = np.random.default_rng(7)
    matrix = rng.dirichlet(np.full(60, 0.5), size=5).T
    size = rng.integers(200, 3000, 40).astype(float)
    y = np.minimum(rng.poisson((rng.dirichlet(np.ones(5), size=40) @ matrix.T) * size[:, None]), lk.MAX_COUNT)
    y[3] = 0  # a spot without counts
    table, grid = lk.count_table(30), lk.rate_grid()
    w, n, ok = deconv.fit_stack(matrix, size, y, table, grid, constrain=constrain)
    monkeypatch.setattr(deconv, "OUTER_CELLS", 0)
    for i in range(40):
        wi, ni, oki = deconv.fit_stack(matrix, size[i:i + 1], y[i:i + 1], table, grid, constrain=constrain)
        assert np.allclose(w[i], wi[0], atol=1e-9) and n[i] == ni[0] and ok[i] == oki[0]
    # Where it settled without a constraint, the slope is zero on what is used and points down elsewhere.
    if not constrain:
        w, _, ok = deconv.fit_stack(matrix, size, y, table, grid, n_iter=400, tol=1e-9)
        for i in np.flatnonzero(ok & (y.sum(1) > 0)):
            h = 1e-4
            f = lambda v, i=i: np.log(lk.probability(np.maximum(matrix @ v * size[i], 1e-4), y[i], table, grid)).sum()
            slope = np.array([(f(w[i] + h * e) - f(w[i] - h * e)) / (2 * h) for e in np.eye(5)]) / size[i]
            assert (np.abs(slope[w[i] > 0.02]) < 0.02).all() and (slope < 0.02).all()


def test_weights_recover_a_mixture(spark):
    rng = np.random.default_rng(9)
    base = rng.dirichlet(np.full(80, 0.4), size=3)
    profiles = spark.createDataFrame([(f"g{g:02d}", "ABC"[t], float(base[t, g])) for t in range(3) for g in range(80)], "gene string, cell_type string, mean double")
    axis = im.gene_axis(profiles)
    data = []
    truth = rng.dirichlet(np.ones(3), size=12)
    for s in range(12):
        data += [(s, f"g{g:02d}", float(v)) for g, v in enumerate(rng.poisson(truth[s] @ base * 1500))]
    counts = spark.createDataFrame(data, "id long, gene string, value double")
    shapes = deconv.Profiles(profiles, axis)
    spots = materialize(deconv.spot_rows(counts, mx.library_sizes(counts), axis), "spots")
    fitted = deconv.fit_spots(spots, shapes, 20)
    for r in fitted.collect():
        w = np.array(r["weights"])
        assert (w >= -1e-12).all() and np.abs(w - truth[r["id"]]).max() < 0.12
    bulk = mx.bulk_vector(counts)
    total = counts.agg(F.sum("value"))
    got = {r["cell_type"]: r["weight"] for r in deconv.fit_bulk(mx.bulk_design(profiles, bulk, total, bulk), total.first()[0]).collect()}
    assert np.allclose([got[t] for t in "ABC"], truth.mean(0), atol=0.1)
    with pytest.raises(ValueError):
        deconv.decompose(counts, mx.library_sizes(counts), profiles, bulk, mode="doublet")


def test_candidates_fall_back(spark):
    data = [(1, i, w) for i, w in enumerate([0.9, 0.05, 0.05, 0.0])] + [(2, i, 0.0) for i in range(4)]
    df = spark.createDataFrame(data, "id long, label long, weight double")
    got = rows(asg.candidate_types(df, 10).select("id", "label"))
    assert got == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)] or got == [(1, 0), (2, 0), (2, 1), (2, 2)]


def test_spot_search_matches_exhaustive_likelihood():
    """Without a prior and with two cells the search is the best pair."""
    rng = np.random.default_rng(10)
    matrix = rng.dirichlet(np.full(25, 0.4), size=3).T
    model = asg.SpotModel(matrix, lk.count_table(30), lk.rate_grid(), 0.0, 1)
    y = rng.poisson((0.7 * matrix[:, 1] + 0.3 * matrix[:, 2]) * 500)
    frac, inner = np.array([0.7, 0.3]), np.full((2, 2), np.nan)
    got = asg.search_spot(model, y, 500.0, np.arange(3), frac, np.array([0, 0]), np.ones((2, 25)), np.zeros((2, 3)), np.zeros(2), inner)
    cost = {(a, b): -np.log(lk.probability((0.7 * matrix[:, a] + 0.3 * matrix[:, b]) * 500, y, model.table, model.grid)).sum()
            for a in range(3) for b in range(3)}
    assert tuple(got) == min(cost, key=cost.get) == (1, 2)
    alone = asg.search_spot(model, y, 500.0, np.arange(3), frac[:1], np.array([0]), np.ones((1, 25)),
                            np.array([[0.0, 0.0, 1e9]]), np.array([1.0]), np.full((1, 1), np.nan))
    assert alone.shape == (1,)


def test_strong_prior_follows_neighbours():
    matrix = np.full((5, 2), 0.2)
    model = asg.SpotModel(matrix, lk.count_table(30), lk.rate_grid(), 50.0, 1)
    args = (np.full(5, 10), 50.0, np.arange(2))
    one = asg.search_spot(model, *args, np.array([1.0]), np.array([0]), np.ones((1, 5)), np.array([[1.0, 5.0]]), np.array([6.0]), np.full((1, 1), np.nan))
    assert one.tolist() == [1]
    inner = np.array([[np.nan, 1.0], [1.0, np.nan]])
    two = asg.search_spot(model, *args, np.array([1.0, 1.0]), np.array([0, 0]), np.ones((2, 5)), np.array([[1.0, 4.0], [1.0, 4.0]]), np.array([5.0, 5.0]), inner)
    assert two.tolist() == [1, 1]


@pytest.mark.parametrize("moves", ["joint", "single"])
def test_effect_of_a_feature_is_found(spark, moves):
    """One feature doubles or halves one gene; the sampler must see its sign and nothing else needs to."""
    from tissuegrid.operators import morphology as mo

    rng = np.random.default_rng(12)
    matrix = np.full((4, 1), 0.25)
    x = rng.choice([-1.0, 1.0], 60)
    rate = matrix[:, 0] * 80 * np.exp(np.outer(x, [0.7, 0, 0, 0]))
    base = spark.createDataFrame([(i, [float(v) for v in rng.poisson(rate[i])], 80.0) for i in range(60)], "spot_id long, v array<double>, size double")
    overlap = spark.createDataFrame([(i, i, 1.0) for i in range(60)], "spot_id long, cell_id long, frac double")
    labels = spark.createDataFrame([(i, 0) for i in range(60)], "id long, label long")
    feats = spark.createDataFrame([(i, [float(x[i])]) for i in range(60)], "id long, v array<double>")
    model = asg.SpotModel(matrix, lk.count_table(10), lk.rate_grid(), 0.0, 0)
    blocks = mo.spot_blocks(base, overlap, labels, feats)
    low, high = mo.gene_scores(blocks, model, [np.zeros((1, 4)), np.array([[0.7, 0, 0, 0]])])
    assert high[0] < low[0] and np.allclose(high[1:], low[1:])
    beta, gamma = mo.sample_effects(blocks, model, iterations=24, seed=3, moves=moves)
    assert gamma[0, 0] == 1 and 0.4 < beta[0, 0] < 1.0
    got = {r["id"]: r["factor"] for r in mo.factors(feats, np.array([[9.0, 0, 0, 0]])).collect()}
    assert max(f[0] for f in got.values()) == 5.0 and all(f[1] == 1.0 for f in got.values())


@pytest.mark.parametrize("moves", ["joint", "single"])
def test_morphology_sampler_matches_the_posterior(monkeypatch, moves):
    """Two features with independent normal likelihoods: inclusion and mean are known in closed form."""
    from tissuegrid.operators import morphology as mo

    centre, width = np.array([[0.9, -0.2], [0.1, 1.4]]), 0.5

    def scores(blocks, model, betas):
        return np.array([(((b - centre) / width) ** 2 / 2).sum(axis=0) for b in betas])

    monkeypatch.setattr(mo, "gene_scores", scores)
    sums, n = np.zeros((2, 2)), 0
    for seed in range(4):
        monkeypatch.setitem(mo.KEEP_SHARE, moves, 0.0)
        model = type("Model", (), {"matrix": np.zeros((2, 1))})
        mean, _ = mo.sample_effects(None, model, start=(np.zeros((2, 2)), None), iterations=12_000, burn=500, seed=seed, moves=moves)
        sums, n = sums + mean, n + 1
    # Bayes factor of "on": normal slab of width 1 against a point mass at zero.
    total = 1 + width ** 2
    on = np.exp(-centre ** 2 / (2 * total)) * width / np.sqrt(total)
    off = np.exp(-centre ** 2 / (2 * width ** 2))
    inclusion = on / (on + off)
    assert np.allclose(sums / n, inclusion * centre / total, atol=0.05)


# ---- models ---------------------------------------------------------------------------------------

def _numeric(f, v, i, h=1e-6):
    d = np.zeros_like(v)
    d[i] = h
    return (f(v + d) - f(v - d)) / (2 * h)


def test_autoencoder_gradient():
    rng = np.random.default_rng(0)
    m = cvae.new_model(12, 2, cvae.CvaeConfig())
    args = (rng.random((20, 12)) * 5, rng.choice([0.0, 10.0], (20, 1)), rng.random(20), rng.normal(size=(20, 6)))
    f = lambda v: cvae.loss_and_gradient(*args, tr.unpack(v, m.params), 2, 1.0)[0]
    _, g, _ = cvae.loss_and_gradient(*args, m.params, 2, 1.0)
    v, flat = tr.pack(m.params), tr.pack(g)
    for i in rng.choice(len(v), 15):
        assert flat[i] == pytest.approx(_numeric(f, v, i), rel=1e-4, abs=1e-4)


def test_batch_moments_of_split_rows():
    rng = np.random.default_rng(2)
    a = 1e6 + rng.normal(size=(30, 4))
    parts = [a[:0], a[:1], a[1:20], a[20:]]
    handed = []
    for p in parts:
        tr.batch_moments(p, lambda v: handed.append(v) or np.ones((1, 9)))
    n, mean, var = tr.batch_moments(parts[0], lambda v: np.stack(handed))
    assert n == 30 and np.allclose(mean, a.mean(0), rtol=1e-14) and np.allclose(var, a.var(0), rtol=1e-8)


@pytest.fixture(scope="module")
def fitted(spark):
    """Autoencoder fitted on rows in ``parts`` partitions, by ``tasks`` tasks, with Arrow batches of ``records`` rows."""
    rng = np.random.default_rng(3)
    data = [(int(k), [float(x) for x in rng.poisson(6, 9)], float(10 * (k % 2)), 0.5 + k % 3) for k in range(90)]
    frame = materialize(spark.createDataFrame(data, "key long, v array<double>, cond double, weight double"))

    def fit(parts, tasks, records, **settings):
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        try:
            m = cvae.new_model(9, 2, cvae.CvaeConfig(**settings))
            m.scale_st = m.scale_sc = (np.zeros(9), np.full(9, 3.0))
            return cvae.train(frame.repartition(parts).limit(0 if not records else 1000), m, tasks)
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    return fit


def _same_model(a, b):
    return np.allclose(a.losses, b.losses, rtol=1e-9) and np.allclose(
        tr.pack(a.running), tr.pack(b.running), rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("batch", [1000, 50])
def test_autoencoder_training_does_not_depend_on_layout(fitted, batch):
    run = lambda *layout: fitted(*layout, epochs=2, batch=batch, norm_rows=16)
    one = run(1, 1, 10_000)
    assert _same_model(one, run(7, 5, 10_000)) and _same_model(one, run(7, 5, 3))
    assert one.losses[1] < one.losses[0]


def test_autoencoder_steps_move_packed_rows(fitted, monkeypatch):
    moved, rows = [], []
    summed = cvae.summed_groups

    def step(df, *rest):
        moved.append(df.count())
        rows.append(sum(len(np.frombuffer(r["keys"], dtype=np.int64)) for r in df.collect()))
        return summed(df, *rest)

    monkeypatch.setattr(cvae, "summed_groups", step)
    fitted(3, 2, 10_000, epochs=2, batch=50, norm_rows=45)
    # Two steps an epoch, each of 8 slices and one group; every row is in one step of an epoch.
    assert len(moved) == 4 and max(moved) <= 8 and rows[0] + rows[1] == rows[2] + rows[3] == 90


def test_autoencoder_over_whole_batches(fitted):
    run = lambda *layout, n: fitted(*layout, epochs=1, norm_rows=n)
    # 90 rows fall into one group of 1024, which is the whole batch of one task.
    assert _same_model(run(1, 1, 10_000, n=1024), run(7, 7, 3, n=None))


def test_autoencoder_without_rows(fitted):
    for n in (16, None):
        with pytest.raises(ValueError, match="no rows"):
            fitted(1, 1, 0, epochs=1, norm_rows=n)


def test_autoencoder_learns_and_is_stored(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = rng.dirichlet(np.full(8, 0.5), size=2)
    frame = lambda n, f: spark.createDataFrame(
        [(i, f"g{g}", float(v)) for i in range(n) for g, v in enumerate(rng.poisson(base[i % 2] * 400) * f) if v], "id long, gene string, value double")
    st_counts, sc_counts = nz.fraction_scale(frame(30, 1.0)), nz.fraction_scale(frame(20, 1.0))
    axis = im.gene_axis(spark.createDataFrame([(f"g{g}",) for g in range(8)], "gene string"))
    model, new_st, _ = cvae.adapt_domains(st_counts, sc_counts, axis, 2, cvae.CvaeConfig(epochs=12, samples=120))
    assert model.losses[-1] < model.losses[0] and new_st.count() == 30
    cvae.save_model(spark, model, str(tmp_path / "m"))
    again = cvae.load_model(spark, str(tmp_path / "m"), 8, 2)
    vectors = im.dense_vectors(st_counts, axis)
    a = {r["id"]: r["v"] for r in cvae.reconstruct(vectors, again, "st").collect()}
    b = {r["id"]: r["v"] for r in new_st.collect()}
    assert all(np.allclose(a[i], b[i]) for i in b)


def test_keyed_noise():
    u = tr.keyed_uniform(np.arange(20_000), 2, 5)
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u.T)[0, 1]) < 0.03
    z = tr.keyed_normal(np.arange(20_000), 2, 5)
    assert abs(z.std() - 1) < 0.02 and np.array_equal(z[7], tr.keyed_normal(np.array([7]), 2, 5)[0])


def test_greedy_search_is_spread_over_tasks(spark):
    model = asg.SpotModel(np.random.default_rng(1).random((5, 3)), lk.count_table(50), lk.rate_grid(), 0.0, 0)
    cells = spark.createDataFrame(
        [(s, 2 * s + c, 1.0, 0, None, None, None) for s in range(40) for c in range(2)],
        "spot_id long, id long, frac double, label long, mass map<long,double>, degree long, inner array<struct<dst: long, weight: double>>")
    spots = spark.createDataFrame([(s, [1.0, 2.0, 0.0, 3.0, 1.0], 2.0) for s in range(40)], "spot_id long, v array<double>, scale double")
    options = spark.createDataFrame([(s, t) for s in range(40) for t in range(3)], "id long, label long")
    got = materialize(asg.greedy_epoch(spots, options, cells, model).withColumn("task", F.spark_partition_id()), "labels")
    assert got.count() == 80 and got.select("task").distinct().count() > 1


@pytest.mark.parametrize("image", [False, True])
def test_identification_broadcasts_no_table_by_its_file_size(spark, monkeypatch, image):
    plans = []

    def noted(df, *how, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, *how, **more)

    monkeypatch.setattr(asg, "materialize", noted)
    rng = np.random.default_rng(4)
    matrix = rng.random((6, 3))
    # Stored, so that sizes are known; their files are far below the bound of a broadcast.
    spots = materialize(spark.createDataFrame(
        [(s, 150.0, [float(x) for x in rng.poisson(20, 6)]) for s in range(12)], "id long, n_umi double, v array<double>"), "spots")
    fitted = materialize(spark.createDataFrame([(s, [0.2, 0.3, 0.5]) for s in range(12)], "id long, weights array<double>"), "fitted")
    overlap = materialize(spark.createDataFrame([(c % 12, c, 1.0) for c in range(24)], "spot_id long, cell_id long, frac double"), "overlap")
    edges = materialize(spark.createDataFrame([(c, (c + 1) % 24, 1.0) for c in range(24)], "src long, dst long, weight double"), "edges")
    features = materialize(spark.createDataFrame([(c, [c / 24.0, 1.0]) for c in range(24)], "id long, v array<double>"), "features")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    labels, _, _ = asg.identify_cells(
        spots, fitted, deconv.Profiles.stored(matrix, ["a", "b", "c"], None), 50, overlap, edges,
        features if image else None, epochs=1, mcmc_iterations=1)
    assert labels.count() == 24
    assert not [p for p in plans if "BroadcastExchange" in p]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_greedy_labels_runs_the_operators_epochs(spark, monkeypatch):
    asked = {}

    def noted(*args, **how):
        asked.update(inspect.signature(whole).bind(*args, **how).arguments)
        return None, None, None

    whole = asg.identify_cells
    monkeypatch.setattr(asg, "identify_cells", noted)
    catalog.QUERIES["greedy_labels"](spark, os.environ.get("SMOKE_SF_DIR", "/root/testdata/sf0.001"))
    default = inspect.signature(whole).parameters["epochs"].default
    assert asked.get("epochs", default) == default == 8
    assert asked.get("n_fit") is None and asked.get("n_entries") is None


def test_sigma_tables_leave_the_driver_after_each_epoch(spark, monkeypatch):
    sent = []
    share = deconv._shared_tables
    monkeypatch.setattr(deconv, "_shared_tables", lambda *a: sent.append(share(*a)) or sent[-1])
    entries = spark.createDataFrame([(float(i % 7) + 0.5, float(i % 5)) for i in range(200)], "x double, y double")
    want = deconv.best_sigma(deconv.score_sigmas(entries, deconv.sigma_window(50)))
    assert deconv.refit_sigma(entries, 50) == want
    assert [os.path.exists(b._path) for b in sent] == [True, False]
    # Tables of one window, not those of all epochs.
    assert lk.count_table.cache_info().maxsize * lk.count_table(50).nbytes < 48e6
