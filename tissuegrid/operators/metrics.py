"""Agreement of predicted and true domains. Input: ``pairs(y_true, y_pred)`` with one row per cell.

Everything reduces to the contingency table, whose size is (classes x classes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuegrid.session import materialize


def contingency(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def _margins(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        table.groupBy("y_true").agg(F.sum("n").alias("n")),
        table.groupBy("y_pred").agg(F.sum("n").alias("n")),
    )


def purity(pairs: DataFrame) -> DataFrame:
    best = contingency(pairs).groupBy("y_pred").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.agg((F.sum("best") / F.sum("n")).alias("purity"))


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def _choose2(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    table = materialize(contingency(pairs), "contingency")
    rows, cols = _margins(table)
    one = table.agg(F.sum(_choose2(F.col("n"))).alias("i"), F.sum("n").alias("n"))
    one = one.withColumn("a", rows.agg(F.sum(_choose2(F.col("n")))).scalar())
    one = one.withColumn("b", cols.agg(F.sum(_choose2(F.col("n")))).scalar())
    expected = F.try_divide(F.col("a") * F.col("b"), _choose2(F.col("n")))
    spread = (F.col("a") + F.col("b")) / 2 - expected
    return one.select(
        F.when(spread == 0, 1.0)
        .otherwise(F.coalesce(F.try_divide(F.col("i") - expected, spread), F.lit(1.0)))
        .alias("ari")
    )


def _entropy(margin: DataFrame, n: Column) -> Column:
    p = F.col("n") / n
    return margin.agg(-F.sum(p * F.log(p))).scalar()


def normalized_mutual_info(pairs: DataFrame) -> DataFrame:
    """Mutual information over the mean of the entropies, natural log; 1 when both are 0."""
    table = materialize(contingency(pairs), "contingency")
    rows, cols = _margins(table)
    total = table.agg(F.sum("n")).scalar()
    joint = (
        table.join(rows.withColumnRenamed("n", "a"), "y_true")
        .join(cols.withColumnRenamed("n", "b"), "y_pred")
    )
    p = F.col("n") / total
    mi = joint.agg(F.sum(p * F.log(p * total * total / (F.col("a") * F.col("b")))).alias("mi"))
    mi = mi.withColumn("h", (_entropy(rows, total) + _entropy(cols, total)) / 2)
    return mi.select(
        F.when(F.col("h") == 0, 1.0).otherwise(F.greatest(F.col("mi"), F.lit(0.0)) / F.col("h")).alias("nmi")
    )


def macro_f1(pairs: DataFrame) -> DataFrame:
    """Unweighted mean of per-label F1 over every label seen on either side."""
    table = materialize(contingency(pairs), "contingency")
    hit = (F.col("y_true") == F.col("y_pred")).cast("long") * F.col("n")
    truth = table.select(F.col("y_true").alias("label"), F.col("n").alias("t"),
                         F.lit(0).cast("long").alias("p"), hit.alias("tp"))
    pred = table.select(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("t"),
                        F.col("n").alias("p"), F.lit(0).cast("long").alias("tp"))
    per = truth.unionByName(pred).groupBy("label").agg(
        F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp")
    )
    return per.agg(F.avg(2 * F.col("tp") / (F.col("t") + F.col("p"))).alias("f1_macro"))


def spot_weights(cells: DataFrame) -> DataFrame:
    """Each cell weighs one over the number of cells in its spot."""
    per_spot = cells.groupBy("spot_id").agg(F.count("*").alias("n_cells"))
    return cells.join(per_spot, "spot_id").withColumn("weight", 1 / F.col("n_cells"))


def enrichment(
    cells: DataFrame, domain_labels: DataFrame, background: str = "None"
) -> DataFrame:
    """Enrichment ratio from ``cells(label, region, weight)`` and ``domain_labels(domain, label)``.

    Per domain: weight of its labels inside the domain over their whole weight. The background
    domain adds ``1 - share of cells`` once per label. The answer is the mean of all entries.
    """
    per_label = materialize(cells.groupBy("label", "region").agg(
        F.sum("weight").alias("w"), F.count("*").alias("n")
    ), "per-label")
    named = domain_labels.where(F.col("domain") != background)
    ratios = (
        per_label.join(named, "label").groupBy("domain")
        .agg((F.sum(F.when(F.col("region") == F.col("domain"), F.col("w")).otherwise(0.0))
              / F.sum("w")).alias("entry"))
        .select("entry")
    )
    total = per_label.agg(F.sum("n")).scalar()
    by_label = per_label.groupBy("label").agg(F.sum("n").alias("n"))
    rest = (
        domain_labels.where(F.col("domain") == background).join(by_label, "label", "left")
        .select((1 - F.coalesce(F.col("n"), F.lit(0)) / total).alias("entry"))
    )
    return ratios.unionByName(rest).agg(F.avg("entry").alias("enrichment"))


def enrichment_soft(
    spot_shares: DataFrame, spots: DataFrame, domain_labels: DataFrame
) -> DataFrame:
    """Probabilistic form: ``spot_shares(spot_id, label, p)`` and ``spots(spot_id, region)``."""
    per = (
        spot_shares.join(spots, "spot_id").groupBy("label", "region").agg(F.sum("p").alias("p"))
        .join(domain_labels, "label").groupBy("domain")
        .agg((F.sum(F.when(F.col("region") == F.col("domain"), F.col("p")).otherwise(0.0))
              / F.sum("p")).alias("entry"))
    )
    return per.agg(F.avg("entry").alias("enrichment"))


def pairs_from_spots(cells: DataFrame, spots: DataFrame, domain_labels: DataFrame) -> DataFrame:
    """Truth is the region of a cell's spot; prediction is the domain of its label."""
    return (
        cells.join(domain_labels, "label").join(spots, "spot_id")
        .select(F.col("region").alias("y_true"), F.col("domain").alias("y_pred"))
    )


def pairs_from_shares(spot_shares: DataFrame, spots: DataFrame, domain_labels: DataFrame) -> DataFrame:
    """Prediction is the domain of the label with the highest share; ties take the first label."""
    major = spot_shares.groupBy("spot_id").agg(
        F.min_by("label", F.struct((-F.col("p")).alias("p"), "label")).alias("label")
    )
    return pairs_from_spots(major, spots, domain_labels)


def pairs_from_mask(
    cells: DataFrame, mask: DataFrame, domain_labels: DataFrame, scale: float
) -> DataFrame:
    """Truth is the domain of the mask pixel under a cell, else ``other``.

    ``mask(px, py, domain, domain_rank)``; a pixel in several domains takes the first rank.
    """
    pixel = mask.groupBy("px", "py").agg(F.min_by("domain", "domain_rank").alias("y_true"))
    located = cells.join(domain_labels, "label").select(
        F.col("domain").alias("y_pred"),
        (F.col("x") * scale).cast("long").alias("px"), (F.col("y") * scale).cast("long").alias("py"),
    )
    return located.join(pixel, ["px", "py"], "left").select(
        F.coalesce("y_true", F.lit("other")).alias("y_true"), "y_pred"
    )
