"""Neighbour joins, graphs, propagation and imputation over the bundled tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tissuegrid.operators import graph as gr
from tissuegrid.operators import impute as im
from tissuegrid.operators import matrix as mx
from tissuegrid.operators import neighbors as nb
from tissuegrid.operators import propagate as lp
from tissuegrid.plans import views as vw
from tissuegrid.plans.registry import query, rounded
from tissuegrid.plans.views import EMB, SC_BRAND, ST_BRAND, TYPES


def _near_sql(k: int, dist: str, cond: str = "a.id <> b.id", a: str = "e", b: str = "e") -> str:
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank
  FROM (SELECT a.id AS query_id, b.id AS ref_id, round({dist}, 10) AS distance FROM {a} a JOIN {b} b ON {cond})) WHERE rank <= {k})"""


D2 = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)"
D3 = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"
COS = "1 - list_cosine_similarity(a.v, b.v)"
E = f"e AS ({EMB})"
SYM = """SELECT query_id AS src, ref_id AS dst FROM nn UNION SELECT ref_id, query_id FROM nn"""


def _out(df):
    return df.select("query_id", "ref_id", "distance", "rank")


@query("knn_euclid", f"WITH {E} SELECT query_id, ref_id, distance, rank FROM {_near_sql(10, D2)}")
def knn_euclid(t):
    p = gr.points(vw.cells(t), ["x", "y"])
    return _out(nb.knn_join(p, p, 10, exclude_self=True))


@query("knn_euclid_3d", f"WITH {E} SELECT query_id, ref_id, distance, rank FROM {_near_sql(10, D3)}")
def knn_euclid_3d(t):
    p = gr.points(vw.cells(t), ["x", "y", "z"])
    return _out(nb.knn_join(p, p, 10, exclude_self=True))


@query("knn_cosine", f"WITH {E} SELECT query_id, ref_id, distance, rank FROM {_near_sql(50, COS)}")
def knn_cosine(t):
    c = vw.cells(t)
    return _out(nb.knn_join(c, c, 50, metric="cosine", exclude_self=True))


@query("knn_in_class", f"""WITH {E} SELECT query_id, ref_id, distance, rank
FROM {_near_sql(50, COS, "a.id <> b.id AND a.label = b.label")}""")
def knn_in_class(t):
    c = vw.cells(t)
    return _out(nb.knn_join(c, c, 50, metric="cosine", by="label", exclude_self=True))


@query("knn_orders_in_class", f"""WITH o AS (SELECT o_orderkey AS id, o_orderstatus || o_orderpriority AS cls,
  o_totalprice / 1000 AS x, (o_orderdate::DATE - DATE '1995-01-01')::DOUBLE AS y FROM orders)
SELECT query_id, ref_id, round(distance, 3) AS distance, rank FROM {_near_sql(5, D2, "a.id <> b.id AND a.cls = b.cls", "o", "o")}""")
def knn_orders_in_class(t):
    """Larger than the broadcast bound, so it runs on blocks along a curve."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    p = t.orders.select(F.col("o_orderkey").alias("id"), F.array(F.col("o_totalprice") / 1000, day).alias("v"),
                        F.concat("o_orderstatus", "o_orderpriority").alias("cls"))
    return rounded(nb.knn_join(p, p, 5, by="cls", exclude_self=True, broadcast_rows=10_000), "distance", digits=3)


RADIUS = """pd AS MATERIALIZED (SELECT a.id AS query_id, b.id AS ref_id, abs(a.x - b.x) + abs(a.y - b.y) AS d FROM e a JOIN e b ON a.id <> b.id),
  od AS MATERIALIZED (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, 10.0::DOUBLE / (SELECT count(*) FROM e) * (count(*) OVER () - 1) AS pos FROM pd WHERE d > 0),
  rr AS MATERIALIZED (SELECT max(CASE WHEN i = floor(pos) THEN d END) + (max(CASE WHEN i = ceil(pos) THEN d END) -
    max(CASE WHEN i = floor(pos) THEN d END)) * any_value(pos - floor(pos)) AS r FROM od)"""


@query("radius_quantile", f"WITH {E}, {RADIUS} SELECT round(r, 8) AS radius FROM rr")
def radius_quantile(t):
    c = vw.cells(t)
    r = nb.pair_distance_quantile(c, ["x", "y"], 10 / c.count())
    return t.spark.range(1).select(F.round(F.lit(r), 8).alias("radius"))


@query("radius_neighbors_l1", f"""WITH {E}, {RADIUS} SELECT query_id, ref_id, round(d, 8) AS distance FROM pd, rr WHERE d > 0 AND d <= r""")
def radius_neighbors_l1(t):
    c = vw.cells(t)
    r = nb.pair_distance_quantile(c, ["x", "y"], 10 / c.count())
    return rounded(nb.radius_neighbors(c, ["x", "y"], r), "distance", digits=8)


@query("knn_graph_symmetric", f"WITH {E}, nn AS {_near_sql(10, D2)} {SYM}")
def knn_graph_symmetric(t):
    return gr.symmetric(gr.knn_edges(vw.cells(t), ["x", "y"], 10))


@query("graph_normalized", f"""WITH {E}, nn AS {_near_sql(10, D2)}, ed AS ({SYM}),
  dg AS (SELECT src AS id, count(*) AS d FROM ed GROUP BY 1)
SELECT src, dst, round(1 / sqrt(a.d * b.d), 9) AS weight FROM ed JOIN dg a ON a.id = src JOIN dg b ON b.id = dst
UNION ALL SELECT id, id, 1.0 FROM e""")
def graph_normalized(t):
    c = vw.cells(t)
    edges = gr.symmetric(gr.knn_edges(c, ["x", "y"], 10)).withColumn("weight", F.lit(1.0))
    return rounded(gr.normalized(edges, c, "after"), "weight", digits=9)


@query("graph_normalized_loops_first", f"""WITH {E}, nn AS {_near_sql(10, D2)}, ed AS ({SYM} UNION ALL SELECT id, id FROM e),
  dg AS (SELECT src AS id, count(*) AS d FROM ed GROUP BY 1)
SELECT src, dst, round(1 / sqrt(a.d * b.d), 9) AS weight FROM ed JOIN dg a ON a.id = src JOIN dg b ON b.id = dst""")
def graph_normalized_loops_first(t):
    c = vw.cells(t)
    edges = gr.symmetric(gr.knn_edges(c, ["x", "y"], 10)).withColumn("weight", F.lit(1.0))
    return rounded(gr.normalized(edges, c, "before"), "weight", digits=9)


SLICED = f"s AS (SELECT *, id % 4 AS slice_rank, label % 3 AS region FROM e)"


def _sliced(t):
    return vw.cells(t).withColumn("slice_rank", F.col("id") % 4).withColumn("label", F.col("label") % 3)


@query("slice_graph", f"""WITH {E}, {SLICED}, nn AS {_near_sql(10, D3, "a.id <> b.id AND a.slice_rank = b.slice_rank", "s", "s")}
SELECT query_id AS src, ref_id AS dst FROM nn JOIN s a ON a.id = query_id JOIN s b ON b.id = ref_id WHERE a.region = b.region""")
def slice_graph(t):
    return gr.slice_edges(_sliced(t), ["x", "y", "z"], 10, by="slice_rank")


@query("between_slice_graph", f"""WITH {E}, {SLICED}, nn AS {_near_sql(5, D3, "a.slice_rank + 1 = b.slice_rank", "s", "s")}
SELECT query_id AS src, ref_id AS dst FROM nn JOIN s a ON a.id = query_id JOIN s b ON b.id = ref_id WHERE a.region = b.region""")
def between_slice_graph(t):
    return gr.between_slice_edges(_sliced(t), ["x", "y", "z"], 5)


@query("stacked_graph", f"""WITH {E}, {SLICED}, ni AS {_near_sql(10, D3, "a.id <> b.id AND a.slice_rank = b.slice_rank", "s", "s")},
  na AS {_near_sql(5, D3, "a.slice_rank + 1 = b.slice_rank", "s", "s")}, al AS (SELECT query_id AS src, ref_id AS dst FROM ni UNION ALL
  (SELECT query_id, ref_id FROM na UNION SELECT ref_id, query_id FROM na))
SELECT src, dst FROM al JOIN s a ON a.id = src JOIN s b ON b.id = dst WHERE a.region = b.region""")
def stacked_graph(t):
    return gr.stacked_edges(_sliced(t), ["x", "y", "z"], 10)


@query("neighbor_cosine_weights", f"""WITH {E}, nn AS {_near_sql(10, D2)}
SELECT query_id AS src, ref_id AS dst, round(list_dot_product(a.v, b.v) /
  (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-10), 6) + 0.0 AS weight
FROM nn JOIN e a ON a.id = query_id JOIN e b ON b.id = ref_id""")
def neighbor_cosine_weights(t):
    c = vw.cells(t)
    return rounded(gr.edge_cosine(gr.knn_edges(c, ["x", "y"], 10), c), "weight")


@query("softmax_attention", f"""WITH {E}, nn AS {_near_sql(10, D2)},
  w AS (SELECT query_id AS src, ref_id AS dst, exp(list_cosine_similarity(a.v, b.v)) AS x FROM nn JOIN e a ON a.id = query_id JOIN e b ON b.id = ref_id)
SELECT src, dst, round(x / sum(x) OVER (PARTITION BY src), 6) AS attention FROM w""")
def softmax_attention(t):
    from tissuegrid.operators.attention import edge_softmax
    c = vw.cells(t)
    edges = gr.edge_cosine(gr.knn_edges(c, ["x", "y"], 10), c)
    return rounded(edge_softmax(edges, "weight").select("src", "dst", "attention"), "attention")


# ---- propagation -----------------------------------------------------------------------------

def _lpa_sql(rounds: int, tail: str) -> str:
    steps = [f"""WITH {E}, nn AS {_near_sql(10, D2)}, ed AS ({SYM}),
  cl AS (SELECT unnest(range(0, 10)) AS label), tr AS (SELECT id, label FROM e WHERE z > 0),
  p0 AS (SELECT id, label, 1.0::DOUBLE AS p FROM tr UNION ALL
         SELECT e.id, cl.label, 0.1::DOUBLE FROM e, cl WHERE e.z <= 0)"""]
    for i in range(rounds):
        steps.append(f"""s{i} AS (SELECT src AS id, label, sum(p) AS p FROM ed JOIN p{i} ON p{i}.id = dst GROUP BY 1, 2),
  n{i} AS (SELECT id, label, p / (sum(p) OVER (PARTITION BY id) + 1e-12) AS p FROM s{i}),
  p{i + 1} AS MATERIALIZED (SELECT * FROM n{i} WHERE id NOT IN (SELECT id FROM tr) UNION ALL SELECT id, label, 1.0::DOUBLE FROM tr)""")
    last = f"""lb AS (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY round(p, 12) DESC, label) AS rn
  FROM p{rounds}) WHERE rn = 1)"""
    return ",\n  ".join([*steps, last]) + tail.format(last=f"p{rounds}")


def _lpa_inputs(t):
    c = vw.cells(t).withColumn("label", F.col("label").cast("long"))
    edges = gr.knn_edges(c, ["x", "y"], 10)
    known = c.where("z > 0").select("id", "label")
    free = c.where("z <= 0").select("id")
    mass = lp.one_hot_mass(known).unionByName(
        lp.uniform_mass(free, t.spark.range(10).withColumnRenamed("id", "label")))
    return c, edges, known, mass


@query("lpa_rounds", _lpa_sql(5, "\nSELECT id, label, round(p, 6) AS p FROM {last}"))
def lpa_rounds(t):
    _, edges, known, mass = _lpa_inputs(t)
    return rounded(lp.propagate(gr.symmetric(edges), mass, 5, known), "p")


@query("lpa_labels", _lpa_sql(5, "\nSELECT id, label::BIGINT AS label FROM lb"))
def lpa_labels(t):
    _, edges, known, mass = _lpa_inputs(t)
    return lp.top_label(lp.propagate(gr.symmetric(edges), mass, 5, known))


@query("lpa_likelihood_refine", _lpa_sql(5, """,
  zs AS (SELECT i, avg(v[i]) AS m, stddev_pop(v[i]) AS s FROM e, unnest(range(1, 65)) AS r(i) GROUP BY 1),
  zl AS (SELECT id, i, (v[i] - m) / s AS z FROM e, unnest(range(1, 65)) AS r(i) JOIN zs USING (i)),
  sz AS (SELECT id, list(z ORDER BY i) AS z FROM zl GROUP BY 1),
  vt AS (SELECT query_id AS id, lb.label, sum(exp(list_dot_product(a.z, b.z) / (sqrt(list_dot_product(a.z, a.z)) * sqrt(list_dot_product(b.z, b.z)) + 1e-10))) AS w
    FROM nn JOIN lb ON lb.id = ref_id JOIN sz a ON a.id = query_id JOIN sz b ON b.id = ref_id WHERE query_id NOT IN (SELECT id FROM tr) GROUP BY 1, 2),
  nw AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(w, 10) DESC, label) AS rn FROM vt) WHERE rn = 1)
SELECT lb.id, coalesce(nw.label, lb.label)::BIGINT AS label FROM lb LEFT JOIN nw ON nw.id = lb.id"""))
def lpa_likelihood_refine(t):
    from tissuegrid.operators.normalize import standardize
    c, edges, known, mass = _lpa_inputs(t)
    labels = lp.top_label(lp.propagate(gr.symmetric(edges), mass, 5, known))
    long = standardize(c.select("id", F.posexplode("v").alias("feature", "value")))
    feats = long.groupBy("id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("feature", "value"))), lambda s: s["value"]).alias("v"))
    near = gr.edge_cosine(edges, feats)
    return lp.refine(near.withColumn("weight", F.exp("weight")), labels, known)


def _smooth_sql(rounds: int) -> str:
    steps = [f"""WITH {E}, {SLICED}, nn AS {_near_sql(10, D3, "a.id <> b.id AND a.slice_rank = b.slice_rank", "s", "s")},
  ed AS (SELECT query_id AS src, ref_id AS dst FROM nn JOIN s a ON a.id = query_id JOIN s b ON b.id = ref_id WHERE a.region = b.region),
  p0 AS (SELECT id, label, 1.0::DOUBLE AS p FROM s)"""]
    for i in range(rounds):
        steps.append(f"""s{i} AS (SELECT src AS id, p{i}.label, sum(p) AS p FROM ed JOIN p{i} ON p{i}.id = dst GROUP BY 1, 2),
  p{i + 1} AS MATERIALIZED (SELECT id, label, p / sum(p) OVER (PARTITION BY id) AS p FROM s{i})""")
    return ",\n  ".join(steps) + f""", nw AS (SELECT id, label FROM (SELECT id, label, row_number() OVER
  (PARTITION BY id ORDER BY round(p, 12) DESC, label) AS rn FROM p{rounds}) WHERE rn = 1)
SELECT s.id, coalesce(nw.label, s.label)::BIGINT AS label FROM s LEFT JOIN nw ON nw.id = s.id"""


@query("lpa_smooth_slices", _smooth_sql(10))
def lpa_smooth_slices(t):
    edges = gr.slice_edges(_sliced(t), ["x", "y", "z"], 10, by="slice_rank")
    return lp.smooth_labels(edges, vw.cells(t).select("id", F.col("label").cast("long").alias("label")), 10)


def _conv_sql(rounds: int) -> str:
    steps = [f"""WITH {E}, nn AS {_near_sql(10, D2)}, eu AS ({SYM}), dg AS (SELECT src AS id, count(*) AS d FROM eu GROUP BY 1),
  ed AS (SELECT src, dst, 1 / sqrt(a.d * b.d) AS w FROM eu JOIN dg a ON a.id = src JOIN dg b ON b.id = dst),
  p0 AS (SELECT id, label, 1.0::DOUBLE AS p FROM e WHERE z > 0)"""]
    for i in range(rounds):
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT src AS id, label, sum(w * p) AS p FROM ed JOIN p{i} ON p{i}.id = dst GROUP BY 1, 2)")
    return ",\n  ".join(steps) + f"\nSELECT id, label::BIGINT AS label, round(p, 6) AS p FROM p{rounds}"


@query("lpa_convolution", _conv_sql(5))
def lpa_convolution(t):
    c, edges, known, _ = _lpa_inputs(t)
    e = gr.normalized(gr.symmetric(edges).withColumn("weight", F.lit(1.0)), c)
    return rounded(lp.propagate(e, lp.one_hot_mass(known), 5, normalize=False), "p")


# ---- imputation --------------------------------------------------------------------------------

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_SEG = "CASE s_nationkey % 5 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SEGMENTS)) + " END"
IMP = f"""sc AS ({SC_BRAND}), st AS ({ST_BRAND}), ty AS ({TYPES}), qt AS (SELECT s_suppkey AS id, {_SEG} AS cell_type FROM supplier)"""


def _imp_near(k: int, same: bool) -> str:
    join = "JOIN ty ON ty.id = b.id JOIN qt ON qt.id = a.id AND qt.cell_type = ty.cell_type" if same else ""
    return f"""qs AS (SELECT id, sqrt(sum(value * value)) AS nm FROM st GROUP BY 1), rs AS (SELECT id, sqrt(sum(value * value)) AS nm FROM sc GROUP BY 1),
  dt AS (SELECT a.id AS query_id, b.id AS ref_id, sum(a.value * b.value) AS dp FROM st a JOIN sc b USING (gene) {join} GROUP BY 1, 2),
  ds AS (SELECT query_id, ref_id, round(1 - dp / (q.nm * r.nm), 10) AS d FROM dt JOIN qs q ON q.id = query_id JOIN rs r ON r.id = ref_id),
  nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS rk FROM ds) WHERE rk <= {k} AND d < 1),
  wt AS (SELECT query_id, ref_id, (1 - d / sum(d) OVER (PARTITION BY query_id)) / (count(*) OVER (PARTITION BY query_id) - 1) AS w FROM nr)"""


def _query_types(t):
    seg = F.element_at(F.array(*map(F.lit, SEGMENTS)), (F.col("s_nationkey") % 5 + 1).cast("int"))
    return t.supplier.select(F.col("s_suppkey").alias("id"), seg.alias("cell_type"))


@query("neighbor_weights", f"WITH {IMP}, {_imp_near(50, True)} SELECT query_id, ref_id, round(w, 6) AS weight FROM wt")
def neighbor_weights(t):
    counts, spots = vw.shared(vw.sc_brand_counts(t)), vw.st_brand_counts(t)
    axis = im.gene_axis(counts)
    near = nb.knn_join(im.dense_vectors(spots, axis).join(_query_types(t), "id"),
                       im.dense_vectors(counts, axis).join(vw.types(t), "id"), 50, metric="cosine", by="cell_type")
    return rounded(im.neighbor_weights(near), "weight")


@query("impute_in_class", f"""WITH {IMP}, {_imp_near(50, True)}
SELECT query_id AS id, gene, round(sum(w * value), 6) AS value FROM wt JOIN sc ON sc.id = ref_id GROUP BY 1, 2""")
def impute_in_class(t):
    counts = vw.shared(vw.sc_brand_counts(t))
    return rounded(im.impute_in_class(vw.st_brand_counts(t), _query_types(t), counts, vw.types(t), counts, 50), "value")


@query("impute_global", f"""WITH {IMP}, {_imp_near(50, False)}
SELECT query_id AS id, gene, round(sum(w * value), 6) AS value FROM wt JOIN sc ON sc.id = ref_id GROUP BY 1, 2""")
def impute_global(t):
    counts = vw.shared(vw.sc_brand_counts(t))
    axis = im.gene_axis(counts)
    return rounded(im.impute_global(im.dense_vectors(vw.st_brand_counts(t), axis),
                                    im.dense_vectors(counts, axis), counts, 50), "value")


def _imp_image_sql() -> str:
    body = _imp_near(50, True)
    return f"""WITH sc AS ({SC_BRAND}), st AS ({ST_BRAND}),
  ty AS (SELECT id, cell_type FROM ({TYPES}) UNION ALL SELECT id, '*' FROM ({TYPES})),
  qt AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey % 5 = 0 THEN '*' WHEN s_nationkey % 5 = 1 THEN 'MACHINERY' ELSE {_SEG} END AS cell_type FROM supplier),
  {body}
SELECT query_id AS id, gene, round(sum(w * value), 6) AS value FROM wt JOIN sc ON sc.id = ref_id GROUP BY 1, 2"""


@query("impute_from_image", _imp_image_sql())
def impute_from_image(t):
    """One label maps to another class, one is unknown to the reference."""
    counts = vw.shared(vw.sc_brand_counts(t))
    axis = im.gene_axis(counts)
    mapping = t.spark.createDataFrame([("AUTOMOBILE", "TRUCK"), ("BUILDING", "MACHINERY")], "cell_type string, class string")
    return rounded(im.impute_from_image(
        im.dense_vectors(vw.st_brand_counts(t), axis), _query_types(t), im.dense_vectors(counts, axis),
        vw.types(t), counts, mapping, 50), "value")


@query("impute_protein", f"""WITH sc AS ({SC_BRAND}), st AS ({ST_BRAND}), gs AS (SELECT DISTINCT gene FROM sc),
  dr AS (SELECT i.id, g.gene, coalesce(sc.value, 0) AS v FROM (SELECT DISTINCT id FROM sc) i CROSS JOIN gs g LEFT JOIN sc ON sc.id = i.id AND sc.gene = g.gene),
  dq AS (SELECT i.id, g.gene, coalesce(st.value, 0) AS v FROM (SELECT DISTINCT id FROM st) i CROSS JOIN gs g LEFT JOIN st ON st.id = i.id AND st.gene = g.gene),
  mr AS (SELECT gene, avg(v) AS m, stddev_pop(v) AS s FROM dr GROUP BY 1), mq AS (SELECT gene, avg(v) AS m, stddev_pop(v) AS s FROM dq GROUP BY 1),
  vr AS (SELECT id, list((v - m) / s ORDER BY gene) AS v FROM dr JOIN mr USING (gene) GROUP BY 1),
  vq AS (SELECT id, list((v - m) / s ORDER BY gene) AS v FROM dq JOIN mq USING (gene) GROUP BY 1),
  nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS rk FROM
    (SELECT a.id AS query_id, b.id AS ref_id, round(1 - list_cosine_similarity(a.v, b.v), 10) AS d FROM vq a JOIN vr b ON true)) WHERE rk <= 50 AND d < 1),
  wt AS (SELECT query_id, ref_id, (1 - d / sum(d) OVER (PARTITION BY query_id)) / (count(*) OVER (PARTITION BY query_id) - 1) AS w FROM nr)
SELECT query_id AS id, 'acctbal' AS gene, round(sum(w * c_acctbal), 4) + 0.0 AS value FROM wt JOIN customer ON c_custkey = ref_id GROUP BY 1""")
def impute_protein(t):
    protein = t.customer.select(F.col("c_custkey").alias("id"), F.lit("acctbal").alias("gene"), F.col("c_acctbal").alias("value"))
    return rounded(im.impute_protein(vw.shared(vw.st_brand_counts(t)), vw.shared(vw.sc_brand_counts(t)), protein, 50), "value", digits=4)


KERNEL = f"""sc AS ({SC_BRAND}), st AS ({ST_BRAND}),
  b AS (SELECT min(c_acctbal) AS lx, max(c_acctbal) AS hx, min(c_nationkey) AS ly, max(c_nationkey) AS hy FROM customer),
  ce AS (SELECT c_custkey AS id, (c_acctbal - lx) / (hx - lx) AS x, (c_nationkey - ly)::DOUBLE / (hy - ly) AS y FROM customer, b),
  so AS (SELECT s_suppkey AS id, (s_acctbal - lx) / (hx - lx) AS x, (s_nationkey - ly)::DOUBLE / (hy - ly) AS y FROM supplier, b),
  nn AS {_near_sql(5, D2, "true", "ce", "so")},
  k0 AS (SELECT query_id AS id, gene, sum(exp(-distance * distance / 0.02) * value) AS v FROM nn JOIN st ON st.id = ref_id GROUP BY 1, 2),
  kr AS (SELECT id, gene, v / (SELECT sum(v) FROM k0) AS value FROM k0)"""


def _kernel(t):
    cells = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    spots = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return im.kernel_expression(cells, spots, vw.st_brand_counts(t))


@query("kernel_expression", f"WITH {KERNEL} SELECT id, gene, round(value * 1e6, 6) AS value FROM kr")
def kernel_expression(t):
    return rounded(_kernel(t).withColumn("value", F.col("value") * 1e6), "value")


@query("spatial_balance", f"""WITH {KERNEL}, bo AS (SELECT kr.id, kr.gene, kr.value AS r, coalesce(sc.value, 0) * kr.value AS sr
  FROM kr LEFT JOIN sc USING (id, gene)), tt AS (SELECT sum(value) AS total FROM sc), ms AS (SELECT sum(sr) AS mass FROM bo)
SELECT id, gene, round((0.95 * sr / mass + (1 - 0.95) * r) * total, 6) AS value FROM bo, tt, ms""")
def spatial_balance(t):
    return rounded(im.spatial_balance(vw.shared(vw.sc_brand_counts(t)), _kernel(t)), "value")


@query("measured_overwrite", f"""WITH sc AS ({SC_BRAND}), m AS (SELECT id, gene, 0.5 * value AS value FROM sc WHERE gene < 'Brand#15')
SELECT id, gene, coalesce(m.value, sc.value) AS value FROM sc LEFT JOIN m USING (id, gene)""")
def measured_overwrite(t):
    counts = vw.shared(vw.sc_brand_counts(t))
    measured = counts.where("gene < 'Brand#15'").withColumn("value", F.col("value") * 0.5)
    return im.overwrite_measured(counts, measured)


# ---- sequential sampling and learned models --------------------------------------------------------

@query("farthest_point_sampling", f"""WITH RECURSIVE {E}, nn AS (SELECT (count(*) * 0.8)::INT AS n FROM e),
  st(step, pick, id, x, y, d) AS (
    SELECT 1, (SELECT min(id) FROM e), id, x, y, sqrt((x - (SELECT arg_min(x, id) FROM e)) ** 2 + (y - (SELECT arg_min(y, id) FROM e)) ** 2) FROM e
    UNION ALL
    SELECT step + 1, b.id, a.id, a.x, a.y, least(a.d, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2))
    FROM st a, (SELECT id, x, y FROM st ORDER BY d DESC, id LIMIT 1) b, nn WHERE step < n)
SELECT DISTINCT pick AS id, step::BIGINT AS pick FROM st""")
def farthest_point_sampling(t):
    from tissuegrid.operators.sampling import farthest_points
    c = gr.points(vw.cells(t), ["x", "y"])
    return farthest_points(c, int(c.count() * 0.8))


@query("attention_labels")
def attention_labels(t):
    """Graph attention fill-up over all cells; those on one side are labelled, few epochs keep the check quick."""
    from tissuegrid.operators import gat
    c = gat.with_order(vw.cells(t))
    nodes = c.select("id", "order", "v", F.when(F.col("z") > 0, F.col("label")).alias("label"))
    edges = gr.knn_edges(vw.cells(t), ["x", "y"], 10)
    return gat.fill_labels(nodes, edges, 10, gat.GatConfig(hidden=16, epochs=5, block_nodes=128))[0]


@query("domain_adaptation")
def domain_adaptation(t):
    """Autoencoder reconstruction of all spots on the reference platform, all cells as reference, after 5 epochs."""
    from tissuegrid.operators import cvae
    from tissuegrid.operators.normalize import fraction_scale
    st, sc = vw.shared(vw.st_brand_counts(t)), vw.shared(vw.sc_brand_counts(t))
    axis = im.gene_axis(st)
    sc = fraction_scale(sc.join(vw.types(t), "id", "left_semi"), 1e4)
    config = cvae.CvaeConfig(epochs=5)
    _, spots, _ = cvae.adapt_domains(fraction_scale(st, 1e4), sc, axis, 5, config)
    return rounded(spots.select("id", F.posexplode("v").alias("ix", "value")), "value", digits=3)
