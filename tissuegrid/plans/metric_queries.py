"""Agreement metrics. Cells are orders, spots are customers, regions are world regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tissuegrid.functions import scalars as fx
from tissuegrid.operators import metrics as mt
from tissuegrid.plans import views as vw
from tissuegrid.plans.registry import query, rounded

# Which labels mark which domain; the last one is the background.
DOMAINS = [("ASIA", "1-URGENT"), ("AMERICA", "2-HIGH"), ("EUROPE", "3-MEDIUM"),
           ("AFRICA", "4-NOT SPECIFIED"), ("None", "5-LOW")]

_VALUES = ", ".join(f"('{d}', '{lab}')" for d, lab in DOMAINS)
BASE = f"""dl(domain, label) AS (VALUES {_VALUES}),
  sp AS (SELECT c_custkey AS spot_id, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey
         JOIN region ON r_regionkey = n_regionkey),
  cl AS (SELECT o_orderkey AS id, o_custkey AS spot_id, o_orderpriority AS label FROM orders),
  pr AS (SELECT region AS y_true, domain AS y_pred FROM cl JOIN dl USING (label) JOIN sp USING (spot_id))"""
CT = BASE + """, ct AS (SELECT y_true, y_pred, count(*) AS n FROM pr GROUP BY 1, 2),
  ra AS (SELECT y_true, sum(n) AS a FROM ct GROUP BY 1), cb AS (SELECT y_pred, sum(n) AS b FROM ct GROUP BY 1)"""


def _domains(t):
    return t.spark.createDataFrame(DOMAINS, "domain string, label string")


def _spots(t):
    return (
        t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
        .select(F.col("c_custkey").alias("spot_id"), F.col("r_name").alias("region"))
    )


def _cells(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("spot_id"),
                           F.col("o_orderpriority").alias("label"))


def _pairs(t):
    return mt.pairs_from_spots(_cells(t), _spots(t), _domains(t))


@query("contingency", f"WITH {CT} SELECT y_true, y_pred, n FROM ct")
def contingency(t):
    return mt.contingency(_pairs(t))


@query("ari", f"""WITH {CT}, s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM ct)::DOUBLE AS i,
  (SELECT sum(a * (a - 1) / 2.0) FROM ra)::DOUBLE AS a, (SELECT sum(b * (b - 1) / 2.0) FROM cb)::DOUBLE AS b,
  (SELECT sum(n) FROM ct)::DOUBLE AS n)
SELECT round((i - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) + 0.0 AS ari FROM s""")
def ari(t):
    return rounded(mt.adjusted_rand(_pairs(t)), "ari")


@query("nmi", f"""WITH {CT}, t AS (SELECT sum(n)::DOUBLE AS n FROM ct)
SELECT round((SELECT sum(ct.n / t.n * ln(ct.n * t.n / (a * b))) FROM ct JOIN ra USING (y_true) JOIN cb USING (y_pred), t) /
  (((SELECT -sum(a / t.n * ln(a / t.n)) FROM ra, t) + (SELECT -sum(b / t.n * ln(b / t.n)) FROM cb, t)) / 2), 6) AS nmi""")
def nmi(t):
    return rounded(mt.normalized_mutual_info(_pairs(t)), "nmi")


@query("purity", f"""WITH {CT} SELECT round(sum(best) / sum(n), 6) AS purity
FROM (SELECT y_pred, max(n) AS best, sum(n) AS n FROM ct GROUP BY 1)""")
def purity(t):
    return rounded(mt.purity(_pairs(t)), "purity")


@query("accuracy", f"WITH {BASE} SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0 END), 6) AS accuracy FROM pr")
def accuracy(t):
    return rounded(mt.accuracy(_pairs(t)), "accuracy")


@query("f1_macro", f"""WITH {CT}, l AS (SELECT y_true AS label FROM ra UNION SELECT y_pred FROM cb),
  s AS (SELECT label, coalesce(a, 0) AS a, coalesce(b, 0) AS b,
    coalesce((SELECT n FROM ct WHERE y_true = label AND y_pred = label), 0) AS tp
    FROM l LEFT JOIN ra ON y_true = label LEFT JOIN cb ON y_pred = label)
SELECT round(avg(2.0 * tp / (a + b)), 6) AS f1_macro FROM s""")
def f1_macro(t):
    return rounded(mt.macro_f1(_pairs(t)), "f1_macro")


@query("inverse_spot_weight", f"""WITH {BASE} SELECT id, spot_id,
  round(1.0 / count(*) OVER (PARTITION BY spot_id), 9) AS weight FROM cl""")
def inverse_spot_weight(t):
    return rounded(mt.spot_weights(_cells(t)).select("id", "spot_id", "weight"), "weight", digits=9)


@query("enrichment_ratio", f"""WITH {BASE},
  w AS (SELECT cl.*, region, 1.0 / count(*) OVER (PARTITION BY spot_id) AS w FROM cl JOIN sp USING (spot_id)),
  e AS (SELECT sum(CASE WHEN region = domain THEN w ELSE 0 END) / sum(w) AS entry
        FROM w JOIN dl USING (label) WHERE domain <> 'None' GROUP BY domain UNION ALL
        SELECT 1 - (SELECT count(*) FROM cl WHERE cl.label = dl.label) / (SELECT count(*) FROM cl)
        FROM dl WHERE domain = 'None')
SELECT round(avg(entry), 6) AS enrichment FROM e""")
def enrichment_ratio(t):
    cells = mt.spot_weights(_cells(t)).join(_spots(t), "spot_id")
    return rounded(mt.enrichment(cells, _domains(t)), "enrichment")


@query("enrichment_soft", f"""WITH {BASE}, sh AS (SELECT spot_id, label, count(*) / sum(count(*)) OVER (PARTITION BY spot_id) AS p
  FROM cl GROUP BY 1, 2)
SELECT round(avg(entry), 6) AS enrichment FROM (SELECT sum(CASE WHEN region = domain THEN p ELSE 0 END) / sum(p) AS entry
  FROM sh JOIN sp USING (spot_id) JOIN dl USING (label) GROUP BY domain)""")
def enrichment_soft(t):
    return rounded(mt.enrichment_soft(_shares(t), _spots(t), _domains(t)), "enrichment")


def _shares(t):
    counted = _cells(t).groupBy("spot_id", "label").count()
    total = counted.groupBy("spot_id").agg(F.sum("count").alias("total"))
    return counted.join(total, "spot_id").select(
        "spot_id", "label", (F.col("count") / F.col("total")).alias("p"))


@query("argmax_label_accuracy", f"""WITH {BASE}, c AS (SELECT spot_id, label, count(*) AS n FROM cl GROUP BY 1, 2),
  m AS (SELECT spot_id, label FROM (SELECT *, row_number() OVER (PARTITION BY spot_id ORDER BY n DESC, label) AS rn FROM c) WHERE rn = 1)
SELECT round(avg(CASE WHEN region = domain THEN 1.0 ELSE 0 END), 6) AS accuracy
FROM m JOIN dl USING (label) JOIN sp USING (spot_id)""")
def argmax_label_accuracy(t):
    return rounded(mt.accuracy(mt.pairs_from_shares(_shares(t), _spots(t), _domains(t))), "accuracy")


@query("region_raster_join", f"""WITH {BASE},
  mk AS (SELECT floor(l_extendedprice / 1000)::BIGINT AS px, l_suppkey AS py,
    CASE l_returnflag WHEN 'A' THEN 'AFRICA' WHEN 'N' THEN 'ASIA' ELSE 'EUROPE' END AS domain,
    CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END AS rk FROM lineitem),
  px AS (SELECT px, py, arg_min(domain, rk) AS y_true FROM mk GROUP BY 1, 2),
  lc AS (SELECT domain AS y_pred, trunc((o_custkey % 600) / 4.0 * 0.8)::BIGINT AS px, trunc((o_orderkey % 130) * 0.8)::BIGINT AS py
    FROM orders JOIN dl ON label = o_orderpriority)
SELECT coalesce(y_true, 'other') AS y_true, y_pred, count(*) AS n FROM lc LEFT JOIN px USING (px, py) GROUP BY 1, 2""")
def region_raster_join(t):
    flag = F.col("l_returnflag")
    mask = t.lineitem.select(
        F.floor(F.col("l_extendedprice") / 1000).alias("px"), F.col("l_suppkey").alias("py"),
        F.when(flag == "A", "AFRICA").when(flag == "N", "ASIA").otherwise("EUROPE").alias("domain"),
        F.when(flag == "A", 2).when(flag == "N", 1).otherwise(0).alias("domain_rank"))
    cells = t.orders.select(F.col("o_orderpriority").alias("label"),
                            ((F.col("o_custkey") % 600) / 4.0).alias("x"),
                            (F.col("o_orderkey") % 130).alias("y"))
    return mt.contingency(mt.pairs_from_mask(cells, mask, _domains(t), 0.8))


# ---- scalar functions ----------------------------------------------------------------------

@query("one_hot", """SELECT vec_id AS id, i - 1 AS class, CASE WHEN label = i - 1 THEN 1 ELSE 0 END AS flag
FROM embeddings, unnest(range(1, 11)) AS r(i)""")
def one_hot(t):
    return vw.cells(t).select("id", F.posexplode(fx.one_hot(F.col("label"), range(10))).alias("class", "flag")).select(
        "id", F.col("class").cast("long").alias("class"), "flag")


@query("scalar_functions", """SELECT event_id AS id, round(ln(1 + value), 6) AS log1p, round(exp(value / 100) - 1, 6) AS expm1,
  round_even(value / 2, 0) AS rint, floor(value)::BIGINT AS floor_value,
  CASE WHEN value > 100 THEN 0.0 ELSE round(value / 3, 6) END AS finite,
  round(value / CASE WHEN user_id = 0 THEN 1 ELSE user_id END, 9) AS ratio,
  round(exp(-pow((value - 5) / 3, 2) / 2) / (3 * sqrt(2 * pi())), 9) AS pdf,
  round(-pow((value - 5) / 3, 2) / 2 - ln(3 * sqrt(2 * pi())), 6) AS log_pdf,
  round(ln(CASE WHEN user_id % 2 = 1 THEN 0.5 ELSE 0.5 END), 6) AS log_prior
FROM events""")
def scalar_functions(t):
    v = F.col("value")
    return rounded(t.events.select(
        F.col("event_id").alias("id"), F.log1p(v).alias("log1p"), F.expm1(v / 100).alias("expm1"),
        F.rint(v / 2).alias("rint"), F.floor(v).alias("floor_value"),
        fx.finite_or_zero(F.when(v > 100, F.lit(float("inf"))).otherwise(v / 3)).alias("finite"),
        fx.ratio_or_one(v, F.col("user_id")).alias("ratio"),
        fx.normal_pdf(v, 5, 3).alias("pdf"), fx.normal_log_pdf(v, 5, 3).alias("log_pdf"),
        fx.inclusion_log_prior(F.col("user_id") % 2).alias("log_prior"),
    ), "log1p", "expm1", "finite", "log_pdf", "log_prior").withColumn("pdf", F.round("pdf", 9)).withColumn("ratio", F.round("ratio", 9))


@query("string_functions", """SELECT p_partkey AS id, upper(p_name) AS upper_name, lower(replace(p_name, ' ', '_')) AS snake,
  'cell_' || p_partkey::VARCHAR AS cell_name, p_brand || '-' || p_type AS pair_name,
  split_part(p_name, ' ', 1) AS head, starts_with(p_name, 'small') AS is_small FROM part""")
def string_functions(t):
    name = F.col("p_name")
    return t.part.select(
        F.col("p_partkey").alias("id"), F.element_at(fx.upper_all(F.array(name)), 1).alias("upper_name"),
        fx.snake_name(name).alias("snake"), F.format_string("cell_%d", F.col("p_partkey")).alias("cell_name"),
        F.concat_ws("-", "p_brand", "p_type").alias("pair_name"), F.split(name, " ")[0].alias("head"),
        name.startswith("small").alias("is_small"))


@query("homography_points", """SELECT vec_id AS id,
  round((1.2 * embedding[1]::DOUBLE + 0.1 * embedding[2]::DOUBLE + 3) / (0.01 * embedding[1]::DOUBLE - 0.02 * embedding[2]::DOUBLE + 1), 6) AS x,
  round((-0.1 * embedding[1]::DOUBLE + 0.9 * embedding[2]::DOUBLE - 2) / (0.01 * embedding[1]::DOUBLE - 0.02 * embedding[2]::DOUBLE + 1), 6) AS y
FROM embeddings""")
def homography_points(t):
    x, y = fx.homography(F.col("x"), F.col("y"), [[1.2, 0.1, 3], [-0.1, 0.9, -2], [0.01, -0.02, 1]])
    return rounded(vw.cells(t).select("id", x.alias("x"), y.alias("y")), "x", "y")
