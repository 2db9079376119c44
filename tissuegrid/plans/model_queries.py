"""Deconvolution, label assignment and morphology effects over the bundled tables.

Spots are suppliers, genes are brands, counts are order lines. Cells are the embedding rows,
spread over the spots by id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tissuegrid.functions import likelihood as lk
from tissuegrid.operators import assign as asg
from tissuegrid.operators import deconv as dc
from tissuegrid.operators import graph as gr
from tissuegrid.operators import matrix as mx
from tissuegrid.operators import morphology as mo
from tissuegrid.operators.impute import gene_axis
from tissuegrid.operators.normalize import standardize
from tissuegrid.plans import views as vw
from tissuegrid.plans.neighbor_queries import D2, E, _near_sql
from tissuegrid.plans.registry import query, rounded
from tissuegrid.session import materialize

STL = ("SELECT l_suppkey AS id, p_brand AS gene, count(*)::DOUBLE AS value FROM lineitem"
       " JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")


def _spot_lines(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_suppkey").alias("id"), F.col("p_brand").alias("gene")).agg(F.count("*").cast("double").alias("value"))


def _cell_lines(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("o_custkey").alias("id"), F.col("p_brand").alias("gene")).agg(F.count("*").cast("double").alias("value"))


def _profiles(t):
    return mx.type_profiles(vw.shared(_cell_lines(t)), vw.types(t))


def _inputs(t):
    counts = vw.shared(_spot_lines(t))
    profiles = vw.shared(_profiles(t))
    axis = gene_axis(profiles)
    spots = materialize(dc.spot_rows(counts, mx.library_sizes(counts), axis), "spots")
    return spots, dc.Profiles(profiles, axis)


# ---- likelihood --------------------------------------------------------------------------------

def _q_sql(sigma: float) -> str:
    """Interpolated table look-up with the table entries computed in place."""
    z, _ = lk.quadrature(sigma * 100)
    step = 2 * lk.Z_LIMIT / (len(z) - 1)
    norm = float(np.exp(-z * z / 2).sum())

    def grid(i: str) -> str:
        return f"1e-5 * pow(least({i} + 1, 900) + greatest({i} + 1 - 900, 0) * 30, 1.5)"

    return f"""st AS ({STL}), pl AS (SELECT id, sum(value) AS n_umi FROM st GROUP BY 1), gt AS (SELECT gene, sum(value) / sum(sum(value)) OVER () AS share FROM st GROUP BY 1),
  en AS (SELECT id, gene, value AS y, n_umi * share * (0.2 + id % 7) AS x FROM st JOIN pl USING (id) JOIN gt USING (gene)),
  e1 AS (SELECT *, least(y, 100) AS k, least(greatest(x, 1e-4), {float(lk.rate_grid()[-1])!r} - 1e-4) AS xc FROM en),
  e2 AS (SELECT *, floor(pow(xc / 1e-5, 2.0 / 3)) AS rw FROM e1),
  e3 AS (SELECT *, least(rw, 900) + floor(greatest(rw - 900, 0) / 30) - 1 AS l FROM e2),
  nd AS (SELECT -6 + i * {step!r}::DOUBLE AS z FROM unnest(range(0, {len(z)})) AS r(i)),
  nw AS (SELECT exp({sigma}::DOUBLE * z) AS f, exp(-z * z / 2) / {norm!r}::DOUBLE AS w FROM nd),
  p AS (SELECT id, gene, any_value(y) AS y, any_value(k) AS k, any_value(xc) AS xc, any_value({grid('l')}) AS x0, any_value({grid('(l + 1)')}) AS x1,
    {", ".join(f"sum(w * exp(-{grid(i)} * f + (k + {j}) * ln({grid(i)} * f) - lgamma(k + {j} + 1))) AS p{j}{n}" for j in range(3) for n, i in ((0, 'l'), (1, '(l + 1)')))}
    FROM e3, nw GROUP BY id, gene),
  q AS (SELECT *, (x1 - xc) / (x1 - x0) AS s FROM p),
  qq AS (SELECT id, gene, xc, k, {", ".join(f"s * p{j}0 + (1 - s) * p{j}1 AS q{j}" for j in range(3))} FROM q),
  tm AS (SELECT id, gene, q0 AS q, -ln(q0) AS nll, (k * q0 - (k + 1) * q1) / xc / q0 AS d1,
    ((k * (k - 1) * q0 - 2 * k * (k + 1) * q1 + (k + 1) * (k + 2) * q2) / (xc * xc)) / q0 - pow((k * q0 - (k + 1) * q1) / xc / q0, 2) AS d2 FROM qq)"""


def _entries(t):
    counts = vw.shared(_spot_lines(t))
    sizes = mx.library_sizes(counts)
    bulk = mx.bulk_vector(counts)
    share = bulk.select("gene", (F.col("total") / bulk.agg(F.sum("total")).scalar()).alias("share"))
    return counts.join(sizes, "id").join(share, "gene").select(
        "id", "gene", F.col("value").alias("y"), (F.col("n_umi") * F.col("share") * (0.2 + F.col("id") % 7)).alias("x"))


@query("count_likelihood", f"WITH {_q_sql(0.5)} SELECT id, gene, round(nll, 5) AS nll, round(d1, 5) + 0.0 AS d1, round(d2, 5) + 0.0 AS d2 FROM tm")
def count_likelihood(t):
    """Interpolated probability, its negative log and both derivatives per spot and gene."""
    return rounded(dc.log_likelihood_terms(_entries(t), 50, "x", "y").select("id", "gene", "nll", "d1", "d2"),
                   "nll", "d1", "d2", digits=5)


@query("negative_log_likelihood", f"WITH {_q_sql(0.5)} SELECT round(sum(nll), 3) AS nll FROM tm")
def negative_log_likelihood(t):
    return rounded(dc.log_likelihood_terms(_entries(t), 50, "x", "y").agg(F.sum("nll").alias("nll")), "nll", digits=3)


@query("sigma_scores")
def sigma_scores(t):
    """Best-multiplier likelihood over the sigma window."""
    entries = _entries(t).withColumn("ix", F.xxhash64("gene"))
    return rounded(dc.score_sigmas(vw.shared(dc.sample_entries(entries)), dc.sigma_window(100)), "score", digits=3)


# ---- deconvolution -----------------------------------------------------------------------------

@query("bulk_weights")
def bulk_weights(t):
    counts = _spot_lines(t)
    bulk = materialize(mx.bulk_vector(counts), "bulk")
    total = bulk.agg(F.sum("total"))
    design = mx.bulk_design(_profiles(t), bulk, total, bulk.select("gene"))
    return rounded(dc.fit_bulk(design, total.first()[0]), "weight")


@query("spot_weights")
def spot_weights(t):
    spots, shapes = _inputs(t)
    return rounded(dc.long_weights(dc.fit_spots(spots, shapes, 50), shapes.types), "weight", digits=4)


@query("sigma_choice")
def sigma_choice(t):
    spots, shapes = _inputs(t)
    sigma = dc.choose_sigma(spots, shapes, min_umi=100)
    return t.spark.range(1).select(F.lit(sigma).alias("sigma"))


WTS = f"""st AS ({STL}), wt AS (SELECT id, replace(gene, 'Brand#', '')::BIGINT % 10 AS label, sum(value * (1 + replace(gene, 'Brand#', '')::BIGINT % 3 * (id % 40))) AS weight FROM st GROUP BY 1, 2)"""


@query("candidate_types", f"""WITH {WTS}, s AS (SELECT *, sum(weight) OVER (PARTITION BY id) AS t FROM wt)
  , k AS (SELECT *, max(weight > least(t / 8, t / 5)) OVER (PARTITION BY id) AS found FROM s)
SELECT id, label, weight FROM k WHERE weight > least(t / 8, t / 5) OR (NOT found AND label IN (0, 1, 2))""")
def candidate_types(t):
    number = F.regexp_replace("gene", "Brand#", "").cast("long")
    weights = _spot_lines(t).groupBy("id", (number % 10).alias("label")).agg(
        F.sum(F.col("value") * (1 + number % 3 * (F.col("id") % 40))).alias("weight"))
    return asg.candidate_types(weights, 4)


# ---- priors and factors ------------------------------------------------------------------------

NBR = f"{E}, nn AS {_near_sql(10, D2)}, ed AS (SELECT query_id AS src, ref_id AS dst, 1 + distance AS w FROM nn)"


def _edges(t):
    return gr.knn_edges(vw.cells(t), ["x", "y"], 10).select(
        "src", "dst", (1 + F.col("distance")).alias("weight"))


@query("potts_prior", f"""WITH {NBR}, ca AS (SELECT e.id, c AS label FROM e, unnest(range(0, 10)) AS r(c))
SELECT ca.id, ca.label, round(10.0 * sum(CASE WHEN e.label <> ca.label THEN w ELSE 0 END) / count(*), 6) AS prior
FROM ca JOIN ed ON src = ca.id JOIN e ON e.id = dst GROUP BY 1, 2""")
def potts_prior(t):
    cells = vw.cells(t).select("id", F.col("label").cast("long").alias("label"))
    every = cells.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("label"))
    return rounded(asg.potts_prior(_edges(t), cells, every, 10.0), "prior")


@query("smooth_prior", f"""WITH {NBR}, f AS (SELECT src AS id, min(dst) AS other FROM ed GROUP BY 1)
SELECT f.id, f.other, round(-10.0 * sum(CASE WHEN CASE WHEN e.id = f.other THEN 3 ELSE label END <> 2 THEN w ELSE 0 END) / count(*), 6) + 0.0 AS prior
FROM f JOIN ed ON src = f.id JOIN e ON e.id = dst GROUP BY 1, 2""")
def smooth_prior(t):
    """Log prior of every cell for one candidate, with its first neighbour imagined relabelled."""
    cells = vw.cells(t).select("id", F.col("label").cast("long").alias("label"))
    edges = materialize(_edges(t), "edges")
    asks = edges.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("other")).select(
        "id", "other", F.lit(2).alias("candidate"), F.lit(3).alias("other_label"))
    return rounded(asg.smooth_prior(edges, cells, asks, 10.0, log=True).select("id", "other", "prior"), "prior")


@query("morphology_factor", """WITH b AS (SELECT i - 1 AS feature, p_brand AS gene, sin((i * length(p_brand) + ascii(substr(p_brand, 7, 1)))::DOUBLE) AS beta
  FROM (SELECT DISTINCT p_brand FROM part), unnest(range(1, 65)) AS r(i)),
  f AS (SELECT vec_id AS id, i - 1 AS feature, embedding[i]::DOUBLE AS value FROM embeddings, unnest(range(1, 65)) AS r(i))
SELECT id, gene, round(least(greatest(exp(sum(value * beta)), 0), 5), 6) AS factor FROM f JOIN b USING (feature) GROUP BY 1, 2""")
def morphology_factor(t):
    feats = vw.cells(t).select("id", F.posexplode("v").alias("feature", "value"))
    brand = F.col("p_brand")
    code = F.ascii(F.substring(brand, 7, 1))
    beta = t.part.select("p_brand").distinct().withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(64)))).select(
        (F.col("i") - 1).alias("feature"), brand.alias("gene"),
        F.sin((F.col("i") * F.length(brand) + code).cast("double")).alias("beta"))
    return rounded(asg.morphology_factor(feats, beta), "factor")


@query("coefficient_priors", """SELECT event_id AS id, CASE WHEN user_id % 2 = 1 THEN round(value * value / 20000 + 0.5 * ln(2 * pi()), 6) END AS coefficient,
  round(ln(0.5::DOUBLE), 6) AS inclusion, round(-ln(CASE WHEN user_id % 2 = 1 THEN 0.3 ELSE 0.7 END), 6) AS fixed_share FROM events""")
def coefficient_priors(t):
    gamma = F.col("user_id") % 2
    return rounded(t.events.select(
        F.col("event_id").alias("id"), asg.coefficient_log_prior(gamma, F.col("value") / 100).alias("coefficient"),
        asg.inclusion_log_likelihood(gamma).alias("inclusion"),
        asg.inclusion_log_likelihood(gamma, 0.3).alias("fixed_share")), "coefficient", "inclusion", "fixed_share")


# ---- assignment --------------------------------------------------------------------------------

def _cells_in_spots(t):
    """Every cell gets a spot."""
    n = t.supplier.agg(F.count("*")).scalar()
    return vw.cells(t).select((F.col("id") % n).alias("spot_id"), F.col("id").alias("cell_id"),
                              ((F.col("label") + 1) / 10.0).alias("frac"))


def _features(t):
    long = vw.cells(t).select("id", F.posexplode("v").alias("feature", "value"))
    scaled = standardize(long)
    return scaled.groupBy("id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("feature", "value"))), lambda s: s["value"]).alias("v"))


def _assignment(t, features, **run):
    spots, shapes = _inputs(t)
    fitted = materialize(dc.fit_spots(spots, shapes, 50), "fitted")
    return asg.identify_cells(
        spots, fitted, shapes, 50, _cells_in_spots(t), materialize(_edges(t), "edges"), features, nu=10.0,
        seed=3, **run), shapes


@query("greedy_labels")
def greedy_labels(t):
    """Labels without morphology: the image-free branch, until sigma settles or for all the operator's epochs."""
    (labels, _, _), _ = _assignment(t, None)
    return labels


@query("assigned_labels_with_morphology")
def assigned_labels_with_morphology(t):
    """Labels with sampled morphology effects; a short chain keeps the check quick."""
    (labels, _, _), _ = _assignment(t, materialize(_features(t), "features"), mcmc_iterations=4, epochs=1)
    return labels


@query("morphology_effects")
def morphology_effects(t):
    """Posterior means of the feature effects per gene from a short chain over all spots."""
    spots, shapes = _inputs(t)
    overlap = materialize(_cells_in_spots(t), "overlap")
    labels = overlap.select(F.col("cell_id").alias("id"), (F.col("cell_id") % len(shapes.types)).alias("label"))
    base = spots.select(F.col("id").alias("spot_id"), "v", F.col("n_umi").alias("size"))
    blocks = mo.spot_blocks(base, overlap, labels, _features(t))
    model = asg.SpotModel(shapes.matrix, lk.count_table(50), lk.rate_grid(), 0.0, 0)
    beta, gamma = mo.sample_effects(blocks, model, iterations=6, seed=5)
    rows = [(f, g, float(beta[f, g]), int(gamma[f, g])) for f in range(beta.shape[0]) for g in range(beta.shape[1])]
    return rounded(t.spark.createDataFrame(rows, "feature int, ix int, beta double, gamma int"), "beta")
