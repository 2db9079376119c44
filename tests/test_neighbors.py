"""Nearest neighbours against brute force, in both physical forms, with piles and ties."""

import datetime

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tissuegrid.operators import neighbors as nb


def brute(q, r, k, metric, same_class=None, exclude=False, ties=False):
    out = {}
    for i, (qid, qv, qc) in enumerate(q):
        rows = []
        for rid, rv, rc in r:
            if (same_class and qc != rc) or (exclude and qid == rid):
                continue
            a, b = np.array(qv), np.array(rv)
            if metric == "cosine":
                na, nb_ = np.linalg.norm(a) or 1, np.linalg.norm(b) or 1
                d = 1 - a @ b / na / nb_
            else:
                d = np.sqrt(((a - b) ** 2).sum())
            rows.append((float(np.round(d, 10)), rid))
        rows.sort()
        if ties and rows:
            rows = [x for x in rows if x[0] <= rows[min(k, len(rows)) - 1][0]]
        else:
            rows = rows[:k]
        out[qid] = rows
    return out


def as_dict(df):
    out = {}
    for row in df.collect():
        out.setdefault(row["query_id"], []).append((row["distance"], row["ref_id"], row["rank"]))
    return {k: sorted(v) for k, v in out.items()}


def check(spark, q, r, k, **how):
    schema = "id long, v array<double>, cls string"
    qd, rd = spark.createDataFrame(q, schema), spark.createDataFrame(r, schema)
    by, metric = how.pop("by", None), how.pop("metric", "euclidean")
    exclude, ties = how.get("exclude_self", False), how.get("ties", False)
    want = brute(q, r, k, metric, by, exclude, ties)
    for form in ({}, {"broadcast_rows": 0, "block_rows": 16}):
        got = as_dict(nb.knn_join(qd, rd, k, metric=metric, by=by, **how, **form))
        for qid, rows in want.items():
            found = [x[:2] for x in got.get(qid, [])]
            assert [x[1] for x in sorted(found)] == [x[1] for x in rows], (form, qid)
            assert np.allclose([x[0] for x in sorted(found)], [x[0] for x in rows], atol=1e-9)
            if not ties:
                assert sorted(x[2] for x in got.get(qid, [])) == list(range(1, len(rows) + 1))


def cloud(n, d, seed, n_cls=2):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(size=d)], "ab"[rng.integers(n_cls)]) for i in range(n)]


def test_plain(spark):
    pts = cloud(120, 2, 1)
    check(spark, pts, pts, 5, exclude_self=True)


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_one_table_against_itself_on_the_curve(spark, dim):
    """A crowd in one place, far outliers, a class of few, a pile of copies, ids of text, rows without class."""
    rng = np.random.default_rng(dim)
    v = np.vstack([rng.normal(size=(150, dim)), 5 + 1e-6 * rng.normal(size=(200, dim)),
                   1e9 * rng.normal(size=(3, dim)), np.tile(np.full((1, dim), 2.0), (60, 1))])
    rows = [(f"n{i:04d}", [float(x) for x in p], "ab"[i % 7 == 0]) for i, p in enumerate(v)]
    rows += [("few0", [0.0] * dim, "c"), ("few1", [-0.0] * dim, "c")]
    nobody = [("none", [0.0] * dim, None)]
    df = spark.createDataFrame(rows + nobody, "id string, v array<double>, cls string")
    want = brute(rows, rows, 5, "euclidean", "cls", True)
    for part in (df, df.where("id <= 'n0352' OR id LIKE 'few%'")):
        if part is not df:
            some = [r for r in rows if r[0] <= "n0352" or r[0].startswith("few")]
            want = brute(some, some, 5, "euclidean", "cls", True)
        got = as_dict(nb.knn_join(part, part, 5, by="cls", exclude_self=True, broadcast_rows=0, block_rows=16))
        for i, near in want.items():
            assert [(round(d, 9), r) for d, r, _ in got.get(i, [])] == [(round(d, 9), r) for d, r in near], i
        assert "none" not in got


def test_blocks_along_the_curve_meet_in_arrow(spark):
    """Lists of neighbours are not made row by row; classes may be times."""
    days = [datetime.datetime(2024, 1, 1 + i) for i in range(3)]
    rows = [(f"n{i:03d}", v, days[i % 3]) for i, v, _ in cloud(160, 2, 8)]
    table = spark.createDataFrame(rows, "id string, v array<double>, cls timestamp")
    for asking in (table, table.where("id < 'n080'")):
        joined = nb.knn_join(asking, table, 4, by="cls", exclude_self=True, broadcast_rows=0, block_rows=16)
        plan = joined._jdf.queryExecution().toString()
        assert "FlatMapCoGroupsInPandas" not in plan
        if asking is table:
            assert "FlatMapCoGroupsInArrow" in plan
        asked = [r for r in rows if asking is table or r[0] < "n080"]
        want = brute(asked, rows, 4, "euclidean", same_class=True, exclude=True)
        got = as_dict(joined)
        assert {q: [x[1] for x in found] for q, found in got.items()} == {q: [x[1] for x in found] for q, found in want.items()}


def test_points_asked_from_far_outside(spark):
    refs = cloud(80, 2, 11, 1)
    asks = [(i, [1e4 * x for x in v], "a") for i, v, _ in cloud(40, 2, 12, 1)] + [(99, [0.0, 0.0], "z")]
    check(spark, asks, refs, 4, by="cls")


def test_pile_of_copies_and_grid_ties(spark):
    """A third of all points share one location, the rest lie on a lattice full of ties."""
    pts = [(i, [3.0, 3.0], "a") for i in range(40)]
    pts += [(40 + i, [float(i % 9), float(i // 9)], "a") for i in range(80)]
    check(spark, pts, pts, 6, exclude_self=True)
    check(spark, pts, pts[40:], 1, ties=True)


def test_cosine_with_zero_vectors_and_class(spark):
    pts = cloud(90, 6, 2) + [(90, [0.0] * 6, "a"), (91, [0.0] * 6, "b")]
    check(spark, pts, pts, 7, metric="cosine")
    check(spark, pts, pts, 7, metric="cosine", by="cls", exclude_self=True)


def test_fewer_references_than_k(spark):
    pts = cloud(6, 3, 3)
    check(spark, cloud(20, 3, 4), pts, 10, by="cls")


def test_wide_vectors_in_blocks(spark):
    check(spark, cloud(60, 24, 5), cloud(150, 24, 6), 9)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=3, max_size=40), st.integers(1, 5))
def test_any_lattice(spark, cells, k):
    pts = [(i, [float(x), float(y)], "a") for i, (x, y) in enumerate(cells)]
    check(spark, pts, pts, k, exclude_self=True)


@pytest.mark.parametrize("copies", [0, 30])
def test_radius_quantile_and_neighbors(spark, copies):
    rng = np.random.default_rng(7)
    xy = np.round(np.vstack([rng.normal(size=(60, 2)), np.tile([[0.5, 0.5]], (copies, 1))]), 2)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    d = np.abs(xy[:, None] - xy[None]).sum(-1)
    q = 8 / len(xy)
    want = np.quantile(d[d > 1e-12], q)
    got = nb.pair_distance_quantile(df, ["x", "y"], q)
    assert got == pytest.approx(want, abs=1e-9)
    r = want + 1e-6
    pairs = {(a, b) for a, b in zip(*np.nonzero((d > 1e-12) & (d <= r)))}
    found = nb.radius_neighbors(df, ["x", "y"], r).select("query_id", "ref_id").collect()
    assert {(x[0], x[1]) for x in found} == pairs and len(found) == len(pairs)


def test_crowded_grid_cell_is_split(spark):
    rng = np.random.default_rng(8)
    xy = rng.random((300, 2))
    locs = spark.createDataFrame([(float(x), float(y), 1) for x, y in xy], "x double, y double, m int")
    n = nb.close_pairs(locs, ["x", "y"], 2.5, unit_rows=20).count()
    assert n == 300 * 299


def test_repartitioning_changes_nothing(spark):
    pts = spark.createDataFrame(cloud(100, 3, 9), "id long, v array<double>, cls string")
    a = as_dict(nb.knn_join(pts.repartition(1), pts.repartition(7), 4, broadcast_rows=0, block_rows=16))
    b = as_dict(nb.knn_join(pts.repartition(5, "id"), pts.repartition(2), 4, broadcast_rows=0, block_rows=32))
    assert a == b
    assert nb.knn_join(pts, pts.where(F.lit(False)), 3).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_blocks_of_many_dimensions_meet_once(spark, metric):
    """Queries in the middle of wide references, piles, equal scores, rows that are not finite; several parts and chunks."""
    rng = np.random.default_rng(3)
    refs = [(i, [float(x) for x in rng.normal(size=5) + 1], "ab"[i % 9 == 0]) for i in range(400)]
    refs += [(400 + i, [1.0, 1.0, 1.0, 1.0, 1.0], "a") for i in range(70)] + [(470 + i, [0.0, 0.0, 0.0, 0.0, float(i % 2)], "a") for i in range(40)]
    asks = [(i, [float(x) for x in 1 + 0.2 * rng.normal(size=5)], "abc"[i % 3]) for i in range(90)]
    schema = "id long, v array<double>, cls string"
    odd = [(900, [float("nan")] * 5, "a"), (901, [float("inf")] + [0.0] * 4, "a")]
    qd, rd = spark.createDataFrame(asks + odd, schema), spark.createDataFrame(refs + odd, schema)
    for ties in (False, True):
        got = as_dict(nb.knn_join(qd, rd, 6, metric=metric, by="cls", ties=ties, broadcast_rows=0, block_rows=1))
        for i, near in brute(asks, refs, 6, metric, 2, ties=ties).items():
            assert [r for _, r, _ in got.get(i, [])] == [r for _, r in near], (ties, i)


def test_wide_blocks_are_searched_without_a_row_per_query_and_pivot(spark):
    """Kernel against the plain form; stretches that double, ended early for queries in the middle."""
    rng = np.random.default_rng(5)
    r = rng.normal(size=(3000, 20)) * rng.random((3000, 1))
    q = 0.01 * rng.normal(size=(700, 20))
    for metric, a, b in (("euclidean", q, r), ("cosine", nb._unit(q, 0), nb._unit(r, 1))):
        got = [np.concatenate(x) for x in zip(*nb.closest(a, b, 7, metric, first=32))]
        want = [np.concatenate(x) for x in zip(*nb.nearest(a, b, 7, metric))]
        assert all((x == y).all() for x, y in zip(got, want))
    same = np.ones((50, 20))
    assert [len(x) for _, x, _, _ in nb.closest(same[:2], same, 3, "euclidean", ties=True, first=8)] == [100]
