"""Matrix algebra, filters, sets, windows and normalisation over the bundled tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tissuegrid.operators import matrix as mx
from tissuegrid.operators import normalize as nz
from tissuegrid.operators.ranking import hash_order, hash_uniform, quantiles
from tissuegrid.operators import sampling
from tissuegrid.plans import views as vw
from tissuegrid.plans.registry import query, rounded
from tissuegrid.plans.views import SC, SC_BRAND, ST, ST_BRAND, TYPES

PROFILE = f"""
  sc AS ({SC}), ty AS ({TYPES}),
  sz AS (SELECT id, sum(value) AS n_umi FROM sc GROUP BY 1),
  cl AS (SELECT sz.id, n_umi, cell_type FROM sz JOIN ty USING (id)),
  nc AS (SELECT cell_type, count(*) AS n FROM cl GROUP BY 1),
  mu AS (SELECT gene, cell_type, sum(value / n_umi) / any_value(n) AS mean
         FROM sc JOIN cl USING (id) JOIN nc USING (cell_type) GROUP BY 1, 2),
  st AS ({ST}), bulk AS (SELECT gene, sum(value) AS total FROM st GROUP BY 1)"""


def _markers_sql(fold: float, expr: float) -> str:
    return f"""WITH {PROFILE},
  ot AS (SELECT *, greatest((sum(mean) OVER (PARTITION BY gene) - mean) / 4, 0) AS other
         FROM mu JOIN bulk USING (gene) WHERE total >= 3 AND NOT starts_with(gene::VARCHAR, 'mt-')),
  sc2 AS (SELECT gene, cell_type, mean, ln(mean + 1e-9) - ln(other + 1e-9) AS log_fold FROM ot)
SELECT gene, cell_type, round(mean, 9) AS mean, round(log_fold, 6) AS log_fold FROM sc2
WHERE log_fold > {fold} AND mean > {expr}"""


def _profiles(t):
    return mx.type_profiles(vw.shared(vw.sc_counts(t)), vw.types(t))


def _markers(t, fold, expr):
    found = mx.marker_genes(_profiles(t), mx.bulk_vector(vw.st_counts(t)), 5, fold, expr)
    return found.select("gene", "cell_type", F.round("mean", 9).alias("mean"),
                        F.round("log_fold", 6).alias("log_fold"))


@query("marker_genes", _markers_sql(1.25, 3e-4))
def marker_genes(t):
    """Regression marker genes per class."""
    return _markers(t, 1.25, 3e-4)


@query("marker_genes_bulk", _markers_sql(1.0, 2e-4))
def marker_genes_bulk(t):
    return _markers(t, 1.0, 2e-4)


@query("marker_gene_union", f"""WITH a AS ({_markers_sql(1.25, 3e-4)}), b AS ({_markers_sql(1.0, 2e-4)})
SELECT gene FROM a UNION SELECT gene FROM b""")
def marker_gene_union(t):
    profiles, bulk = vw.shared(_profiles(t)), vw.shared(mx.bulk_vector(vw.st_counts(t)))
    return mx.gene_union(*[mx.marker_genes(profiles, bulk, 5, fold, level) for fold, level in ((1.25, 3e-4), (1.0, 2e-4))])


@query("celltype_mean_profile",
       f"WITH {PROFILE} SELECT gene, cell_type, round(mean, 9) AS mean FROM mu")
def celltype_mean_profile(t):
    return rounded(_profiles(t), "mean", digits=9)


@query("celltype_counts", """SELECT c_mktsegment AS cell_type, count(*) AS n_cells,
  count(*) >= 25 AS enough FROM customer GROUP BY 1""")
def celltype_counts(t):
    return mx.type_counts(vw.types(t))


@query("library_size", f"WITH st AS ({ST}) SELECT id, sum(value) AS n_umi FROM st GROUP BY 1")
def library_size(t):
    return mx.library_sizes(vw.st_counts(t))


@query("bulk_vector", f"WITH st AS ({ST}) SELECT gene, sum(value) AS total FROM st GROUP BY 1")
def bulk_vector(t):
    return mx.bulk_vector(vw.st_counts(t))


@query("restrict_counts", f"""WITH st AS ({ST}), sz AS (SELECT id, sum(value) AS n_umi FROM st GROUP BY 1)
SELECT id, gene, value, n_umi FROM st JOIN sz USING (id)
WHERE n_umi BETWEEN 1000 AND 15200 AND gene IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def restrict_counts(t):
    counts = vw.shared(vw.st_counts(t))
    genes = t.part.where("p_size > 10").select(F.col("p_partkey").alias("gene"))
    return mx.restrict_counts(counts, mx.library_sizes(counts), genes, 1000, 15200).select(
        "id", "gene", "value", "n_umi")


@query("restrict_barcodes", f"""WITH st AS ({ST}),
  k AS (SELECT s_suppkey AS id FROM supplier WHERE s_acctbal > 0)
SELECT id, gene, value FROM st WHERE id IN (SELECT id FROM k)""")
def restrict_barcodes(t):
    keep = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    return mx.restrict_ids(keep, vw.st_counts(t))[0].select("id", "gene", "value")


@query("barcode_intersection", f"""WITH st AS ({ST}), co AS (SELECT DISTINCT s_suppkey AS id FROM supplier),
  cn AS (SELECT DISTINCT id FROM st), sh AS (SELECT id FROM co INTERSECT SELECT id FROM cn)
SELECT (SELECT count(*) FROM co) AS n_coords, (SELECT count(*) FROM cn) AS n_counts,
  (SELECT count(*) FROM cn) AS n_sizes, (SELECT count(*) FROM sh) AS n_shared,
  (SELECT count(*) FROM sh) > 0 AND (SELECT count(*) FROM sh) =
  greatest((SELECT count(*) FROM co), (SELECT count(*) FROM cn)) AS consistent""")
def barcode_intersection(t):
    counts = vw.shared(vw.st_counts(t))
    coords = t.supplier.select(F.col("s_suppkey").alias("id"))
    return mx.barcode_report(coords, counts, mx.library_sizes(counts)).select(
        *[F.col(c).cast("long").alias(c) for c in ("n_coords", "n_counts", "n_sizes", "n_shared")],
        "consistent")


SIZED = f"""sc AS ({SC}), sz AS (SELECT id, sum(value) AS n_umi FROM sc GROUP BY 1),
  md AS (SELECT quantile_cont(n_umi, 0.5) AS target FROM sz)"""


@query("library_normalize", f"""WITH {SIZED}
SELECT id, gene, round(value / n_umi * target, 6) AS value FROM sc JOIN sz USING (id), md""")
def library_normalize(t):
    return rounded(nz.library_normalize(vw.shared(vw.sc_counts(t))), "value")


@query("log_norm_median", f"""WITH {SIZED}
SELECT id, gene, round(ln(value / n_umi * target + 1), 6) AS value FROM sc JOIN sz USING (id), md""")
def log_norm_median(t):
    return rounded(nz.log_to_median(vw.shared(vw.sc_counts(t))), "value")


@query("log_norm_million", f"""WITH {SIZED}
SELECT id, gene, round(ln(value / n_umi * 1e6 + 1), 6) AS value FROM sc JOIN sz USING (id)""")
def log_norm_million(t):
    return rounded(nz.log_per_million(vw.shared(vw.sc_counts(t))), "value")


@query("fraction_scale", f"""WITH {SIZED}
SELECT id, gene, round(value / n_umi * 1e4, 6) AS value FROM sc JOIN sz USING (id)""")
def fraction_scale(t):
    return rounded(nz.fraction_scale(vw.shared(vw.sc_counts(t))), "value")


@query("median_library_size", f"WITH {SIZED} SELECT round(target, 6) AS target FROM md")
def median_library_size(t):
    return rounded(nz.median_size(vw.sc_counts(t)), "target")


@query("unlog_heuristic", f"""WITH raw AS (SELECT vec_id AS id, i - 1 AS gene, embedding[i]::DOUBLE AS value
  FROM embeddings, unnest(range(1, 65)) AS r(i)),
  mx AS (SELECT max(value) AS top FROM raw)
SELECT id, gene, round(CASE WHEN top < 30 THEN exp(value) - 1 ELSE value END, 6) + 0.0 AS value FROM raw, mx""")
def unlog_heuristic(t):
    long = vw.cells(t).select("id", F.posexplode("v").alias("gene", "value"))
    return rounded(nz.unlog_if_log_scale(long.withColumn("gene", F.col("gene").cast("long"))), "value")


@query("gene_zscore", f"""WITH sc AS ({SC_BRAND}), n AS (SELECT count(DISTINCT id) AS n FROM sc),
  dense AS (SELECT c.id, g.gene, coalesce(sc.value, 0) AS value
    FROM (SELECT DISTINCT id FROM sc) c CROSS JOIN (SELECT DISTINCT gene FROM sc) g
    LEFT JOIN sc ON sc.id = c.id AND sc.gene = g.gene),
  m AS (SELECT gene, avg(value) AS mu, stddev_pop(value) AS sd FROM dense GROUP BY 1)
SELECT sc.id, sc.gene, round((value - mu) / nullif(sd, 0), 6) + 0.0 AS z,
  round(-mu / nullif(sd, 0), 6) + 0.0 AS zero_z FROM sc JOIN m USING (gene)""")
def gene_zscore(t):
    counts = vw.shared(vw.sc_brand_counts(t))
    n = mx.library_sizes(counts).agg(F.count("*")).scalar()
    return rounded(nz.gene_zscore(counts, n), "z", "zero_z")


LONG = """lg AS (SELECT vec_id AS id, i - 1 AS feature, embedding[i]::DOUBLE AS value
  FROM embeddings, unnest(range(1, 65)) AS r(i))"""


def _features(t):
    return vw.cells(t).select("id", F.posexplode("v").alias("feature", "value")).withColumn(
        "feature", F.col("feature").cast("long"))


@query("standardize_features", f"""WITH {LONG},
  m AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd FROM lg GROUP BY 1)
SELECT id, feature, round((value - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) + 0.0 AS value
FROM lg JOIN m USING (feature)""")
def standardize_features(t):
    return rounded(nz.standardize(_features(t)).select("id", "feature", "value"), "value")


@query("minmax_scale", f"""WITH {LONG}, m AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM lg GROUP BY 1)
SELECT id, feature, round((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 10, 6) AS value
FROM lg JOIN m USING (feature)""")
def minmax_scale(t):
    long = _features(t)
    return rounded(nz.min_max_apply(long, nz.min_max_fit(long)).select("id", "feature", "value"), "value")


@query("minmax_roundtrip", f"""WITH {LONG} SELECT id, feature, round(value, 6) + 0.0 AS value FROM lg""")
def minmax_roundtrip(t):
    long = _features(t)
    fit = nz.min_max_fit(long)
    return rounded(nz.min_max_invert(nz.min_max_apply(long, fit), fit).select("id", "feature", "value"), "value")


@query("coordinate_scale", """WITH e AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
  b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM e)
SELECT id, round((x - lx) / (hx - lx), 6) AS x, round((y - ly) / (hy - ly), 6) AS y FROM e, b""")
def coordinate_scale(t):
    cells = vw.cells(t).select("id", "x", "y")
    return rounded(nz.scale_coordinates(cells, cells, ["x", "y"]), "x", "y")


@query("percentile_clip", """WITH b AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM events)
SELECT event_id AS id, round((least(greatest(value, lo), hi) - lo) / (hi - lo), 6) AS shown FROM events, b""")
def percentile_clip(t):
    ev = t.events.select(F.col("event_id").alias("id"), "value")
    return rounded(nz.percentile_clip(ev, "value", 0.02).select("id", "shown"), "shown")


@query("quantiles_by_class", """SELECT event_type, round(quantile_cont(value, 0.01), 6) AS p01,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99
FROM events GROUP BY 1""")
def quantiles_by_class(t):
    probs = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    return rounded(quantiles(t.events, "value", probs, ["event_type"]), *probs)


@query("rescale_reconstruction", f"""WITH st AS ({ST_BRAND}), rc AS (SELECT id, gene, sqrt(value) AS value FROM st),
  g AS (SELECT id, sum(value) AS got FROM rc GROUP BY 1), w AS (SELECT id, sum(value) AS want FROM st GROUP BY 1)
SELECT id, gene, round_even(value / got * want, 0) AS value FROM rc JOIN g USING (id) JOIN w USING (id)""")
def rescale_reconstruction(t):
    raw = vw.shared(vw.st_brand_counts(t))
    return nz.rescale_to_totals(raw.withColumn("value", F.sqrt("value")), raw)


@query("blend_reconstruction", f"""WITH st AS ({ST_BRAND}),
  rc AS (SELECT id, gene, value * 2 AS value FROM st WHERE value > 200)
SELECT id, gene, round(0.3 * st.value + 0.7 * coalesce(rc.value, 0), 6) AS value
FROM st LEFT JOIN rc USING (id, gene)""")
def blend_reconstruction(t):
    raw = vw.shared(vw.st_brand_counts(t))
    recon = raw.where("value > 200").withColumn("value", F.col("value") * 2)
    return rounded(nz.blend(raw, recon, 0.7), "value")


@query("drop_lowest_45pct", f"""WITH st AS ({ST_BRAND}),
  n AS (SELECT floor(0.55 * count(DISTINCT gene) * (SELECT count(*) FROM supplier)) AS keep FROM st),
  r AS (SELECT *, row_number() OVER (ORDER BY value DESC, gene DESC, id DESC) AS rk FROM st WHERE value > 0)
SELECT id, gene, value FROM r, n WHERE rk <= keep""")
def drop_lowest_45pct(t):
    counts = vw.shared(vw.st_brand_counts(t))
    n_genes = counts.select("gene").distinct().count()
    return mx.keep_top_share(counts, n_genes, t.supplier.count()).select("id", "gene", "value")


RENORM = f"""{PROFILE},
  pr AS (SELECT cell_type, n / (SELECT sum(n) FROM nc) AS w FROM nc),
  av AS (SELECT gene, CASE WHEN sum(mean * w) = 0 THEN 1e-6 ELSE sum(mean * w) END AS avg
         FROM mu JOIN pr USING (cell_type) GROUP BY 1)"""


@query("renorm_reference", f"""WITH {RENORM}
SELECT gene, cell_type, round(mean * (total / (SELECT sum(total) FROM bulk) / avg), 9) AS mean
FROM mu JOIN av USING (gene) JOIN bulk USING (gene)""")
def renorm_reference(t):
    counts = vw.shared(vw.sc_counts(t))
    bulk = vw.shared(mx.bulk_vector(vw.st_counts(t)))
    seen = mx.library_sizes(counts).join(vw.types(t), "id")
    props = seen.groupBy("cell_type").agg(F.count("*").cast("double").alias("weight"))
    total = bulk.agg(F.sum("total"))
    profiles = vw.shared(mx.type_profiles(counts, vw.types(t)))
    return rounded(mx.renormalized_profiles(profiles, bulk, total, props), "mean", digits=9)


@query("bulk_design", f"""WITH {PROFILE}
SELECT gene, cell_type, round(mean * (SELECT sum(total) FROM bulk), 4) AS x, total AS b
FROM mu JOIN bulk USING (gene) WHERE total >= 10 AND gene IN (SELECT p_partkey FROM part WHERE p_size <= 25)""")
def bulk_design(t):
    bulk = vw.shared(mx.bulk_vector(vw.st_counts(t)))
    genes = t.part.where("p_size <= 25").select(F.col("p_partkey").alias("gene"))
    return rounded(mx.bulk_design(_profiles(t), bulk, bulk.agg(F.sum("total")), genes), "x", digits=4)


@query("overlap_weighted_mean", f"""WITH ov AS (SELECT l_suppkey AS spot_id, o_custkey AS cell_id, sum(l_discount) AS frac
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING sum(l_discount) > 0),
  sc AS ({SC_BRAND}), tt AS (SELECT spot_id, sum(frac) AS total FROM ov GROUP BY 1)
SELECT ov.spot_id, gene, round(sum(frac * value) / any_value(total), 6) AS value
FROM ov JOIN sc ON sc.id = cell_id JOIN tt ON tt.spot_id = ov.spot_id GROUP BY 1, 2""")
def overlap_weighted_mean(t):
    ov = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("l_suppkey").alias("spot_id"), F.col("o_custkey").alias("cell_id")
    ).agg(F.sum("l_discount").alias("frac")).where("frac > 0")
    values = vw.sc_brand_counts(t).withColumnRenamed("id", "cell_id")
    return rounded(mx.overlap_mean(ov, values), "value")


@query("grand_sum_normalize", f"""WITH st AS ({ST_BRAND})
SELECT id, gene, round(value / (SELECT sum(value) FROM st), 9) AS value FROM st""")
def grand_sum_normalize(t):
    return rounded(mx.grand_sum_normalize(vw.shared(vw.st_brand_counts(t))), "value", digits=9)


@query("mean_impute", """WITH lg AS (
  SELECT event_id AS id, 'k' AS feature, (props::JSON ->> '$.k')::DOUBLE AS value FROM events UNION ALL
  SELECT event_id, 'missing', (props::JSON ->> '$.m')::DOUBLE FROM events UNION ALL
  SELECT event_id, 'value', CASE WHEN value > 50 THEN NULL ELSE value END FROM events),
  m AS (SELECT feature, avg(value) AS fill FROM lg GROUP BY 1)
SELECT id, feature, round(coalesce(value, fill), 6) AS value FROM lg JOIN m USING (feature)""")
def mean_impute(t):
    props = F.from_json("props", "map<string,double>")
    wide = t.events.select(
        F.col("event_id").alias("id"), F.try_element_at(props, F.lit("k")).alias("k"),
        F.try_element_at(props, F.lit("m")).alias("missing"),
        F.when(F.col("value") <= 50, F.col("value")).alias("value"))
    long = wide.unpivot("id", ["k", "missing", "value"], "feature", "value")
    return rounded(mx.mean_fill(long), "value")


@query("group_stats", """SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
  min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1""")
def group_stats(t):
    med = quantiles(t.events, "value", {"median": 0.5}, ["event_type"])
    return rounded(mx.group_stats(t.events, "event_type", "value", med), "mean", "median", "std")


@query("group_moments", """WITH m AS (SELECT event_type, avg(value) AS mu FROM events GROUP BY 1)
SELECT event_type, count(*) AS n, round(any_value(mu), 6) AS mean, round(stddev_pop(value), 6) AS std,
  round(avg(pow(value - mu, 3)) / pow(avg(pow(value - mu, 2)), 1.5), 6) AS skew,
  round(avg(pow(value - mu, 4)) / pow(avg(pow(value - mu, 2)), 2) - 3, 6) AS kurt
FROM events JOIN m USING (event_type) GROUP BY 1""")
def group_moments(t):
    return rounded(mx.group_moments(t.events, "event_type", "value"), "mean", "std", "skew", "kurt")


@query("clamp_factor", """SELECT l_orderkey AS id, l_linenumber AS line,
  least(greatest(l_quantity / 5 - 2, 0), 5) AS factor FROM lineitem""")
def clamp_factor(t):
    from tissuegrid.functions.scalars import clamp
    return t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
                             clamp(F.col("l_quantity") / 5 - 2, 0, 5).alias("factor"))


# ---- filters, sets, ordering -------------------------------------------------------------

@query("roi_filter", """SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings
WHERE embedding[1] > -0.1 AND embedding[1] < 0.1 AND embedding[2] > -0.05 AND embedding[2] < 0.2""")
def roi_filter(t):
    from tissuegrid.operators.plotdata import in_box
    return in_box(vw.cells(t), -0.1, 0.1, -0.05, 0.2).select("id", "x", "y")


@query("slice_filter", """SELECT event_id AS id, event_type AS slice_id FROM events WHERE event_type IN ('click', 'view')""")
def slice_filter(t):
    from tissuegrid.operators.idsets import in_slices
    return in_slices(t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("slice_id")),
                     "slice_id", ["click", "view"])


@query("label_subset", """SELECT vec_id AS id, CASE WHEN label IN (1, 4, 7) THEN label END AS label FROM embeddings""")
def label_subset(t):
    from tissuegrid.operators.plotdata import null_other_labels
    return null_other_labels(vw.cells(t), "label", [1, 4, 7]).select("id", "label")


@query("region_ids", """SELECT n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'
INTERSECT SELECT DISTINCT c_nationkey FROM customer""")
def region_ids(t):
    from tissuegrid.operators.idsets import common_ids, in_region
    members = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region"))
    regions = t.region.select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"))
    return common_ids(in_region(members, regions, ["ASIA"]), t.customer.select(F.col("c_nationkey").alias("id")))


@query("unlabelled_difference", """SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels""")
def unlabelled_difference(t):
    from tissuegrid.operators.idsets import missing_ids
    return missing_ids(t.documents.withColumnRenamed("doc_id", "id"), t.labels.withColumnRenamed("doc_id", "id"))


@query("id_union_outer", """WITH a AS (SELECT DISTINCT o_custkey AS id, 1 AS has_cell FROM orders),
  b AS (SELECT DISTINCT user_id AS id, 1 AS has_nucleus FROM events)
SELECT id, has_cell, has_nucleus FROM a FULL OUTER JOIN b USING (id)""")
def id_union_outer(t):
    from tissuegrid.operators.idsets import union_ids
    return union_ids(t.orders.select(F.col("o_custkey").alias("id")), t.events.select(F.col("user_id").alias("id")),
                     "has_cell", "has_nucleus")


@query("domain_map", """SELECT c_custkey AS id, coalesce(r_name, 'n' || c_nationkey::VARCHAR) AS domain
FROM customer LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE r_name <> 'EUROPE') ON n_nationkey = c_nationkey""")
def domain_map(t):
    lookup = t.nation.join(t.region.where("r_name <> 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    label = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    return t.customer.join(lookup, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("c_custkey").alias("id"), F.coalesce("r_name", label).alias("domain"))


@query("first_occurrence", """SELECT o_custkey AS id, min(o_orderkey) AS first_pos FROM orders GROUP BY 1""")
def first_occurrence(t):
    from tissuegrid.operators.plotdata import first_positions
    return first_positions(t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos")))


@query("natural_sort", """SELECT p_brand AS name, row_number() OVER (ORDER BY regexp_extract(p_brand, '^[^0-9]*'),
  regexp_extract(p_brand, '[0-9]+')::BIGINT) AS pos FROM (SELECT DISTINCT p_brand FROM part)""")
def natural_sort(t):
    from tissuegrid.operators.plotdata import natural_positions
    return natural_positions(t.part.select(F.col("p_brand").alias("name")).distinct())


@query("top_interactions", """WITH lr AS (SELECT l_suppkey::VARCHAR || '/' || o_custkey::VARCHAR AS pair, sum(l_extendedprice) AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
  sp AS (SELECT pair, score, split_part(pair, '/', 1)::BIGINT AS a, split_part(pair, '/', 2)::BIGINT AS b FROM lr)
SELECT pair, round(score, 4) AS score, n_name AS sender, c_mktsegment AS receiver FROM sp
JOIN supplier ON s_suppkey = a JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey JOIN customer ON c_custkey = b
WHERE c_mktsegment = 'MACHINERY' AND r_name = 'ASIA'
ORDER BY sp.score DESC, pair LIMIT 100""")
def top_interactions(t):
    from tissuegrid.operators.plotdata import top_interactions as top
    scores = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.concat_ws("/", F.col("l_suppkey").cast("string"), F.col("o_custkey").cast("string")).alias("pair")
    ).agg(F.sum("l_extendedprice").alias("score"))
    asia = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    senders = t.supplier.join(asia, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").cast("string").alias("cell"), F.col("n_name").alias("sender"))
    receivers = t.customer.where("c_mktsegment = 'MACHINERY'").select(
        F.col("c_custkey").cast("string").alias("cell"), F.col("c_mktsegment").alias("receiver"))
    return rounded(top(scores, senders, receivers, 100), "score", digits=4).select(
        "pair", "score", "sender", "receiver")


# ---- tables behind figures -----------------------------------------------------------------

@query("gene_layer", f"""WITH st AS ({ST_BRAND}), d AS (SELECT s_suppkey AS id, coalesce(value, 0) AS value
  FROM supplier LEFT JOIN st ON st.id = s_suppkey AND gene = 'Brand#12'),
  b AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM d)
SELECT id, value, round((least(greatest(value, lo), hi) - lo) / (hi - lo), 6) AS shown FROM d, b""")
def gene_layer(t):
    from tissuegrid.operators.plotdata import gene_layer as layer
    spots = t.supplier.select(F.col("s_suppkey").alias("id"))
    return rounded(layer(vw.st_brand_counts(t), spots, "Brand#12", 0.05), "shown")


@query("proportion_layer", f"""WITH st AS ({ST_BRAND}), sh AS (SELECT id, gene, value / sum(value) OVER (PARTITION BY id) AS share FROM st)
SELECT s_suppkey AS id, n_name AS region, gene, round(share, 6) AS share FROM supplier JOIN nation ON n_nationkey = s_nationkey
LEFT JOIN sh ON sh.id = s_suppkey WHERE n_name = (SELECT min(n_name) FROM nation JOIN supplier ON s_nationkey = n_nationkey)""")
def proportion_layer(t):
    from tissuegrid.operators.plotdata import proportion_layer as layer
    counts = vw.shared(vw.st_brand_counts(t))
    shares = nz.fraction_scale(counts, 1.0).withColumnRenamed("value", "share")
    spots = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_suppkey").alias("id"), F.col("n_name").alias("region"))
    first = spots.agg(F.min("region")).scalar()
    return rounded(layer(spots.withColumn("_first", first).where("region = _first").drop("_first"), shares), "share").select(
        "id", "region", "gene", "share")


@query("cell_layer", """SELECT vec_id AS id, CASE WHEN label IN (2, 5) THEN label END AS label FROM embeddings
WHERE embedding[1] > -0.2 AND embedding[1] < 0.15 AND embedding[2] > -0.1 AND embedding[2] < 0.3""")
def cell_layer(t):
    from tissuegrid.operators.plotdata import cell_layer as layer
    return layer(vw.cells(t), "label", [2, 5], (-0.2, 0.15, -0.1, 0.3)).select("id", "label")


@query("binary_assignment", """SELECT DISTINCT l_suppkey AS spot_id, o_custkey AS cell_id, 1.0::DOUBLE AS frac
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def binary_assignment(t):
    from tissuegrid.operators.spots import binary_assignment as assign
    return assign(t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("spot_id"), F.col("o_custkey").alias("cell_id")))


# ---- sampling ------------------------------------------------------------------------------

@query("sample_per_class", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY md5('7:' || id::VARCHAR), id) AS rn
  FROM ({TYPES}))
SELECT id, cell_type FROM r WHERE rn <= 20""")
def sample_per_class(t):
    return sampling.sample_per_class(vw.types(t), 20, seed=7)


@query("sample_large_classes", f"""WITH c AS (SELECT max(n) AS top FROM (SELECT count(*) AS n FROM ({TYPES}) GROUP BY cell_type)),
  r AS (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY md5('7:' || id::VARCHAR), id) AS rn FROM ({TYPES}))
SELECT id, cell_type FROM r, c WHERE top <= 250 OR rn <= 100""")
def sample_large_classes(t):
    return sampling.sample_if_large(vw.types(t), limit=250, n=100, seed=7)


@query("sample_rows", """SELECT l_orderkey, l_linenumber FROM lineitem
ORDER BY md5('3:' || l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR), l_orderkey, l_linenumber LIMIT 1000""")
def sample_rows(t):
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    return sampling.sample_rows(t.lineitem, key, 1000, seed=3).select("l_orderkey", "l_linenumber")


@query("cap_per_spot", """WITH oc AS (SELECT DISTINCT l_suppkey AS spot_id, o_custkey AS cell_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  r AS (SELECT *, row_number() OVER (PARTITION BY spot_id ORDER BY md5('5:' || cell_id::VARCHAR), cell_id) AS rn FROM oc)
SELECT spot_id, cell_id FROM r WHERE rn <= 10""")
def cap_per_spot(t):
    pairs = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("spot_id"), F.col("o_custkey").alias("cell_id")).distinct()
    return sampling.cap_per_spot(pairs, 10, seed=5)


@query("sample_fraction", """SELECT event_id AS id FROM events
WHERE ('0x' || substr(md5('11:' || event_id::VARCHAR), 1, 13))::BIGINT / pow(2, 52) < 0.1""")
def sample_fraction(t):
    return t.events.select(F.col("event_id").alias("id")).where(hash_uniform(F.col("id"), 11) < 0.1)


@query("initial_labels", f"""SELECT doc_id AS id, coalesce(l.quality, ('0x' || substr(md5('13:' || d.doc_id::VARCHAR), 1, 13))::BIGINT % 5)::BIGINT AS label
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def initial_labels(t):
    known = t.labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("known"))
    drawn = t.documents.select(F.col("doc_id").alias("id")).join(known, "id", "left")
    return sampling.initial_labels(drawn, "known", 5, seed=13).select("id", "label")


@query("pseudo_mixtures", f"""WITH sc AS ({SC_BRAND}),
  ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS ix FROM (SELECT DISTINCT id FROM sc)),
  n AS (SELECT count(*) AS n FROM ids),
  dr AS (SELECT m, j, ('0x' || substr(md5('1:' || m::VARCHAR || '-' || j::VARCHAR), 1, 13))::BIGINT % n AS ix,
      ('0x' || substr(md5('2:' || m::VARCHAR || '-' || j::VARCHAR), 1, 13))::BIGINT / pow(2, 52) AS w,
      row_number() OVER (PARTITION BY m ORDER BY md5('3:' || m::VARCHAR || '-' || j::VARCHAR), j)
        > ('0x' || substr(md5('4:' || m::VARCHAR), 1, 13))::BIGINT % 7 AS active
    FROM (SELECT id AS m FROM ids) mm, unnest(range(0, 8)) AS r(j), n),
  wt AS (SELECT m, ix, w / sum(w) OVER (PARTITION BY m) AS w FROM dr WHERE active)
SELECT m AS mix_id, gene, round(sum(w * value), 6) AS value FROM wt JOIN ids USING (ix) JOIN sc USING (id) GROUP BY 1, 2""")
def pseudo_mixtures(t):
    counts = vw.shared(vw.sc_brand_counts(t))
    mixes = counts.select(F.col("id").alias("mix_id")).distinct()
    return rounded(sampling.random_mix(counts, mixes, k=8, k_min=2), "value")
