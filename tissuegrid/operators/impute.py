"""Expression and protein transfer from reference cells to spatial cells by weighted neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.operators.neighbors import knn_join
from tissuegrid.operators.normalize import gene_moments, scale_coordinates
from tissuegrid.operators.ranking import row_numbers
from tissuegrid.session import materialize

KERNEL_WIDTH = 0.1
KERNEL_SPOTS = 5
BALANCE = 0.95
WHOLE = "*"  # class that stands for the whole reference


def gene_axis(genes: DataFrame) -> DataFrame:
    """Sorted distinct genes with positions 0, 1, 2, ..."""
    axis = row_numbers(genes.select("gene").distinct(), [F.col("gene")], "_rn")
    return materialize(axis.select("gene", (F.col("_rn") - 1).cast("int").alias("ix")), "genes")


def _scatter(fill):
    """Column function: a cell's (position, value) pairs over a copy of the fill vector."""

    @F.pandas_udf("array<double>")
    def scatter(ix: pd.Series, value: pd.Series) -> pd.Series:
        base, out = fill.value, []
        for i, v in zip(ix, value):
            row = base.copy()
            row[i] = v
            out.append(row)
        return pd.Series(out)

    return scatter


def dense_vectors(counts: DataFrame, axis: DataFrame, default: DataFrame | None = None) -> DataFrame:
    """``(id, v)`` over the gene axis. ``default`` gives ``zero_z`` per gene for absent entries.

    The fill vector is as long as the gene axis, and so is a cell's group at most.
    """
    fill = np.zeros(axis.count())
    if default is not None:
        known = default.join(axis, "gene").select("ix", "zero_z").toPandas()
        fill[known["ix"]] = known["zero_z"]
    scatter = _scatter(counts.sparkSession.sparkContext.broadcast(fill))
    entries = counts.join(axis, "gene").groupBy("id").agg(
        F.collect_list(F.struct("ix", F.col("value").cast("double").alias("value"))).alias("e"))
    return entries.select("id", scatter("e.ix", "e.value").alias("v"))


def neighbor_weights(near: DataFrame, lone: str = "nearest", coincident: str = "equal") -> DataFrame:
    """Weights ``(1 - d / sum d) / (n - 1)`` over neighbours with ``d < 1``; they sum to one.

    With fewer than two such neighbours the nearest one is copied, or nothing (``lone="zero"``).
    Where all distances are zero the weights tend to ``1 / n``; ``coincident="zero"`` gives none.
    """
    per = Window.partitionBy("query_id")  # at most k rows
    valid = F.col("distance") < 1
    tagged = near.withColumn("_n", F.sum(valid.cast("int")).over(per)).withColumn(
        "_sum", F.sum(F.when(valid, F.col("distance")).otherwise(0.0)).over(per))
    flat = F.lit(0.0) if coincident == "zero" else 1 / F.col("_n")
    many = F.when(F.col("_sum") > 0, (1 - F.col("distance") / F.col("_sum")) / (F.col("_n") - 1)).otherwise(flat)
    few = F.when(F.col("rank") == 1, 1.0) if lone == "nearest" else F.lit(None).cast("double")
    w = F.when(F.col("_n") > 1, F.when(valid, many)).otherwise(few)
    return tagged.select("query_id", "ref_id", w.alias("weight")).where("weight IS NOT NULL")


def weighted_profiles(weights: DataFrame, ref_counts: DataFrame) -> DataFrame:
    """Weighted sum of the reference rows: ``(id, gene, value)`` per query."""
    refs = ref_counts.select(F.col("id").alias("ref_id"), "gene", "value")
    return weights.join(refs, "ref_id").groupBy(F.col("query_id").alias("id"), "gene").agg(
        F.sum(F.col("weight") * F.col("value")).alias("value"))


def impute_in_class(
    signatures: DataFrame, cell_types: DataFrame, ref_counts: DataFrame, ref_types: DataFrame,
    genes: DataFrame, k: int = 50, common: DataFrame | None = None, **how,
) -> DataFrame:
    """Search each cell's signature among reference cells of its own type and average their counts.

    ``signatures(id, gene, value)`` covers the search genes; all genes of the reference (or those
    in ``common``) are returned.
    """
    axis = gene_axis(genes)
    q = dense_vectors(signatures, axis).join(cell_types, "id")
    r = dense_vectors(ref_counts, axis).join(ref_types, "id")
    near = knn_join(q, r, k, metric="cosine", by="cell_type", **how)
    target = ref_counts if common is None else ref_counts.join(common.select("gene"), "gene", "left_semi")
    return weighted_profiles(neighbor_weights(near), target)


def impute_from_image(
    query_vectors: DataFrame, query_types: DataFrame, ref_vectors: DataFrame, ref_types: DataFrame,
    ref_counts: DataFrame, subclass_map: DataFrame | None = None, k: int = 50, **how,
) -> DataFrame:
    """Class-restricted search in a shared feature space; too few neighbours give zero (no row).

    Labels pass through ``subclass_map(cell_type, class)`` where listed. A class that the
    reference lacks is searched in the whole reference.
    """
    q = query_vectors.join(query_types, "id")
    if subclass_map is not None:
        q = q.join(subclass_map, "cell_type", "left").withColumn(
            "cell_type", F.coalesce("class", "cell_type")).drop("class")
    r = ref_vectors.join(ref_types, "id").select("id", "v", "cell_type")
    known = ref_types.select("cell_type").distinct().withColumn("_known", F.lit(True))
    q = materialize(
        q.join(known, "cell_type", "left")
        .withColumn("cell_type", F.when(F.col("_known"), F.col("cell_type")).otherwise(F.lit(WHOLE)))
        .select("id", "v", "cell_type"), "queries")
    if q.where(F.col("cell_type") == WHOLE).limit(1).count():
        r = r.unionByName(r.withColumn("cell_type", F.lit(WHOLE)))
    near = knn_join(q, r, k, metric="cosine", by="cell_type", **how)
    return weighted_profiles(neighbor_weights(near, lone="zero", coincident="zero"), ref_counts)


def impute_global(
    query_vectors: DataFrame, ref_vectors: DataFrame, ref_values: DataFrame, k: int = 50,
    lone: str = "nearest", **how,
) -> DataFrame:
    """Unrestricted search; ``ref_values(id, gene, value)`` is what gets transferred."""
    near = knn_join(query_vectors, ref_vectors, k, metric="cosine", **how)
    return weighted_profiles(neighbor_weights(near, lone=lone), ref_values)


def zscore_vectors(counts: DataFrame, axis: DataFrame) -> DataFrame:
    """Z-scored dense vectors; constant genes score 0 everywhere. Reads ``counts`` three times."""
    n = counts.agg(F.count_distinct("id")).scalar()
    moments = materialize(gene_moments(counts, n), "moments")
    safe = F.when(F.col("std") > 0, F.col("std"))
    zero = moments.select("gene", F.coalesce(-F.col("mean") / safe, F.lit(0.0)).alias("zero_z"))
    zero = axis.join(zero, "gene", "left").select("gene", F.coalesce("zero_z", F.lit(0.0)).alias("zero_z"))
    scored = counts.join(moments, "gene").select(
        "id", "gene", F.coalesce((F.col("value") - F.col("mean")) / safe, F.lit(0.0)).alias("value"))
    return dense_vectors(scored, axis, zero)


def impute_protein(
    query_counts: DataFrame, ref_counts: DataFrame, protein: DataFrame, k: int = 50,
    use_zscore: bool = True, **how,
) -> DataFrame:
    """Protein levels from cells measured in both modalities; too few neighbours give no row."""
    shared = query_counts.select("gene").distinct().join(ref_counts.select("gene").distinct(), "gene")
    axis = gene_axis(shared)
    make = zscore_vectors if use_zscore else dense_vectors
    return impute_global(make(query_counts, axis), make(ref_counts, axis), protein, k, lone="zero", **how)


def kernel_expression(cells: DataFrame, spots: DataFrame, spot_counts: DataFrame, **how) -> DataFrame:
    """Gaussian-kernel blend of the nearest spots per cell, scaled so that all entries sum to 1."""
    axes = ["x", "y"]
    scaled_cells = scale_coordinates(cells.select("id", *axes), cells, axes)
    scaled_spots = scale_coordinates(spots.select("id", *axes), cells, axes)
    near = knn_join(
        scaled_cells.select("id", F.array(*axes).alias("v")),
        scaled_spots.select("id", F.array(*axes).alias("v")), KERNEL_SPOTS, **how)
    d = F.col("distance")
    weights = near.select("query_id", "ref_id", F.exp(-d * d / (2 * KERNEL_WIDTH ** 2)).alias("weight"))
    blended = materialize(weighted_profiles(weights, spot_counts), "kernel")
    return blended.withColumn("value", F.col("value") / blended.agg(F.sum("value")).scalar())


def spatial_balance(imputed: DataFrame, kernel: DataFrame, alpha: float = BALANCE) -> DataFrame:
    """Pull imputed expression towards the local spot expression, keeping the grand total."""
    s = imputed.select("id", "gene", F.col("value").alias("_s"))
    r = kernel.select("id", "gene", F.col("value").alias("_r"))
    both = r.join(s, ["id", "gene"], "left").withColumn("_sr", F.coalesce(F.col("_s"), F.lit(0.0)) * F.col("_r"))
    total = imputed.agg(F.sum("value")).scalar()
    mass = both.agg(F.sum("_sr")).scalar()
    return both.select("id", "gene", (
        (alpha * F.col("_sr") / mass + (1 - alpha) * F.col("_r")) * total).alias("value"))


def overwrite_measured(predicted: DataFrame, measured: DataFrame) -> DataFrame:
    """Measured genes replace predictions; ``measured`` must list its zeros for measured genes."""
    p = predicted.select("id", "gene", F.col("value").alias("_p"))
    m = measured.select("id", "gene", F.col("value").alias("_m"))
    return p.join(m, ["id", "gene"], "full_outer").select(
        "id", "gene", F.coalesce("_m", "_p").alias("value"))
