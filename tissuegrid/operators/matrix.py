"""Long-format count matrices: ``counts(id, gene, value)`` with absent rows meaning zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.operators.ranking import row_numbers

EPS_LOG = 1e-9


def library_sizes(counts: DataFrame) -> DataFrame:
    """Total per spot or cell over all loaded genes."""
    return counts.groupBy("id").agg(F.sum("value").alias("n_umi"))


def bulk_vector(counts: DataFrame) -> DataFrame:
    return counts.groupBy("gene").agg(F.sum("value").alias("total"))


def type_counts(types: DataFrame, cell_min: int = 25) -> DataFrame:
    """Cells per type; ``enough`` flags the types that reach the advisory minimum."""
    return (
        types.groupBy("cell_type")
        .agg(F.count("*").alias("n_cells"))
        .withColumn("enough", F.col("n_cells") >= cell_min)
    )


def type_profiles(counts: DataFrame, types: DataFrame) -> DataFrame:
    """Mean over the cells of a type of ``value / library size``; zeros count in the mean."""
    cells = library_sizes(counts).join(types, "id")
    n_cells = cells.groupBy("cell_type").agg(F.count("*").alias("n_cells"))
    summed = (
        counts.join(cells, "id")
        .groupBy("cell_type", "gene")
        .agg(F.sum(F.col("value") / F.col("n_umi")).alias("s"))
    )
    return summed.join(n_cells, "cell_type").select(
        "gene", "cell_type", (F.col("s") / F.col("n_cells")).alias("mean")
    )


def marker_genes(
    profiles: DataFrame,
    bulk: DataFrame,
    n_types: int,
    fold: float = 1.25,
    expression: float = 1.5e-4,
    min_obs: float = 3,
) -> DataFrame:
    """Genes whose log ratio to the unweighted mean of the other types, and level, pass the cuts."""
    measured = bulk.where(
        (F.col("total") >= min_obs) & ~F.col("gene").cast("string").startswith("mt-")
    ).select("gene")
    per_gene = Window.partitionBy("gene")  # at most one row per type
    other = (F.sum("mean").over(per_gene) - F.col("mean")) / F.lit(n_types - 1)
    # Clamp the rounding residue of a gene seen in one type only.
    other = F.greatest(other, F.lit(0.0))
    scored = profiles.join(measured, "gene", "left_semi").withColumn(
        "log_fold", F.log(F.col("mean") + EPS_LOG) - F.log(other + EPS_LOG)
    )
    return scored.where((F.col("log_fold") > fold) & (F.col("mean") > expression))


def gene_union(*marker_tables: DataFrame) -> DataFrame:
    out = marker_tables[0].select("gene")
    for table in marker_tables[1:]:
        out = out.unionByName(table.select("gene"))
    return out.distinct()


def restrict_counts(
    counts: DataFrame, sizes: DataFrame, genes: DataFrame | None, low: float = 1, high: float = 20000
) -> DataFrame:
    """Spots within ``low <= n_umi <= high`` and listed genes; ``n_umi`` is kept as it was."""
    kept = sizes.where(F.col("n_umi").between(low, high)).select("id", "n_umi")
    out = counts.join(kept, "id")
    return out.join(genes.select("gene"), "gene", "left_semi") if genes is not None else out


def restrict_ids(barcodes: DataFrame, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """Align tables keyed by ``id`` to one key list."""
    keys = barcodes.select("id")
    return tuple(t.join(keys, "id", "left_semi") for t in tables)


def barcode_report(coords: DataFrame, counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: ids per table, ids shared by all three, and whether they agree."""
    tagged = [
        t.select("id", *[F.lit(int(i == j)).alias(f"t{j}") for j in range(3)])
        for i, t in enumerate((coords, counts, sizes))
    ]
    seen = (
        tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
        .groupBy("id").agg(*[F.max(f"t{j}").alias(f"t{j}") for j in range(3)])
    )
    total = [F.coalesce(F.sum(f"t{j}"), F.lit(0)).alias(n)
             for j, n in enumerate(("n_coords", "n_counts", "n_sizes"))]
    shared = F.coalesce(F.sum(F.col("t0") * F.col("t1") * F.col("t2")), F.lit(0)).alias("n_shared")
    return seen.agg(*total, shared).withColumn(
        "consistent",
        (F.col("n_shared") > 0) & (F.col("n_shared") == F.greatest("n_coords", "n_counts", "n_sizes")),
    )


def check_barcodes(coords: DataFrame, counts: DataFrame, sizes: DataFrame) -> None:
    row = barcode_report(coords, counts, sizes).first()
    if row["n_shared"] == 0:
        raise ValueError("coordinates, counts and library sizes share no id")
    if not row["consistent"]:
        raise ValueError("coordinates, counts and library sizes do not hold the same ids")


def bulk_design(
    profiles: DataFrame, bulk: DataFrame, total_umi: DataFrame, genes: DataFrame, min_obs: float = 10
) -> DataFrame:
    """Design rows ``(gene, cell_type, x)`` and observation ``b`` of the bulk fit."""
    observed = bulk.where(F.col("total") >= min_obs).join(genes.select("gene"), "gene", "left_semi")
    return profiles.join(observed, "gene").select(
        "gene", "cell_type", (F.col("mean") * total_umi.scalar()).alias("x"), F.col("total").alias("b")
    )


def renormalized_profiles(
    profiles: DataFrame, bulk: DataFrame, total_umi: DataFrame, proportions: DataFrame
) -> DataFrame:
    """Scale each gene so that the proportion-weighted profile meets the bulk level."""
    share = F.col("weight") / proportions.agg(F.sum("weight")).scalar()
    weighted = (
        profiles.join(proportions, "cell_type")
        .groupBy("gene").agg(F.sum(F.col("mean") * share).alias("avg"))
        .withColumn("avg", F.when(F.col("avg") == 0, 1e-6).otherwise(F.col("avg")))
    )
    factor = weighted.join(bulk, "gene").select(
        "gene", (F.col("total") / total_umi.scalar() / F.col("avg")).alias("factor")
    )
    return profiles.join(factor, "gene").select(
        "gene", "cell_type", (F.col("mean") * F.col("factor")).alias("mean")
    )


def keep_top_share(counts: DataFrame, n_genes: int, n_spots: int, share: float = 0.55) -> DataFrame:
    """Zero the lowest entries of the dense gene x spot matrix, keeping ``int(share * size)``.

    Absent zeros are the lowest entries of the dense matrix, so ranking the stored positive
    entries from the top gives the same matrix. Ties are broken by gene, then spot.
    """
    keep = int(share * n_genes * n_spots)
    ranked = row_numbers(
        counts.where(F.col("value") > 0),
        [F.col("value").desc(), F.col("gene").desc(), F.col("id").desc()],
        "rank",
    )
    return ranked.where(F.col("rank") <= keep).drop("rank")


def overlap_mean(overlap: DataFrame, cell_values: DataFrame, weighted: bool = True) -> DataFrame:
    """Per spot and gene: overlap-weighted mean of ``cell_values(cell_id, gene, value)``.

    The divisor is the overlap of every cell of the spot, also of cells without the gene.
    """
    if not weighted:
        return cell_values
    total = overlap.groupBy("spot_id").agg(F.sum("frac").alias("total"))
    summed = (
        overlap.join(cell_values, "cell_id")
        .groupBy("spot_id", "gene").agg(F.sum(F.col("frac") * F.col("value")).alias("s"))
    )
    return summed.join(total, "spot_id").select(
        "spot_id", "gene", (F.col("s") / F.col("total")).alias("value")
    )


def grand_sum_normalize(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("value")).scalar()
    return counts.withColumn("value", F.col("value") / total)


def mean_fill(long: DataFrame) -> DataFrame:
    """``(id, feature, value)``: NULL and NaN become the mean of the feature's other values."""
    clean = F.when(~F.isnan("value"), F.col("value"))
    means = long.groupBy("feature").agg(F.avg(clean).alias("fill"))
    return long.join(means, "feature").select(
        "id", "feature", F.coalesce(clean, F.col("fill")).alias("value")
    )


def group_stats(long: DataFrame, key: str, value: str, median_table: DataFrame) -> DataFrame:
    """Mean, median, min, max and population std per key; empty groups give zeros."""
    stats = long.groupBy(key).agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.stddev_pop(value).alias("std"),
    )
    joined = stats.join(median_table, key, "left")
    cols = ("mean", "median", "min", "max", "std")
    return joined.select(key, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols])


def group_moments(long: DataFrame, key: str, value: str) -> DataFrame:
    """Biased skewness and excess kurtosis with the moments they rest on."""
    return long.groupBy(key).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"),
    )
