"""Normalisations of long-format matrices. ``n_rows`` is the number of cells, so zeros count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuegrid.operators.matrix import library_sizes
from tissuegrid.operators.ranking import median, quantiles

LOG_SCALE_MAX = 30.0


def unlog_if_log_scale(counts: DataFrame) -> DataFrame:
    """Undo ``log1p`` where the largest value says the matrix is on the log scale."""
    top = counts.agg(F.max("value")).scalar()
    return counts.withColumn(
        "value", F.when(top < LOG_SCALE_MAX, F.expm1("value")).otherwise(F.col("value"))
    )


def _with_size(counts: DataFrame) -> DataFrame:
    return counts.join(library_sizes(counts), "id")


def median_size(counts: DataFrame) -> DataFrame:
    return median(library_sizes(counts), "n_umi", "target")


def library_normalize(counts: DataFrame) -> DataFrame:
    """Scale each cell to the median library size."""
    target = median_size(counts).scalar()
    return _with_size(counts).select(
        "id", "gene", (F.col("value") / F.col("n_umi") * target).alias("value")
    )


def fraction_scale(counts: DataFrame, scale: float = 1e4) -> DataFrame:
    return _with_size(counts).select(
        "id", "gene", (F.col("value") / F.col("n_umi") * scale).alias("value")
    )


def log_per_million(counts: DataFrame) -> DataFrame:
    return fraction_scale(counts, 1e6).withColumn("value", F.log1p("value"))


def log_to_median(counts: DataFrame) -> DataFrame:
    return library_normalize(counts).withColumn("value", F.log1p("value"))


def gene_moments(counts: DataFrame, n_rows: Column) -> DataFrame:
    """Mean and population std per gene over all cells, absent zeros included."""
    agg = counts.groupBy("gene").agg(
        F.sum("value").alias("s"), F.count("*").alias("n"),
        F.avg("value").alias("m"), F.var_pop("value").alias("v"),
    )
    mean = F.col("s") / n_rows
    # Combine the variance of the stored entries with that of the absent zeros.
    var = (F.col("n") * F.col("v") + F.col("n") * F.col("m") * (F.col("m") - mean)) / n_rows
    return agg.select("gene", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))


def gene_zscore(counts: DataFrame, n_rows: Column, fill: float | None = None) -> DataFrame:
    """Stored entries as ``(value - mean) / std`` plus ``zero_z``, the score of an absent zero.

    A constant gene has no score: NULL, or ``fill`` where the caller wants a number.
    """
    std = F.when(F.col("std") > 0, F.col("std"))
    default = F.lit(fill).cast("double")
    return counts.join(gene_moments(counts, n_rows), "gene").select(
        "id", "gene",
        F.coalesce((F.col("value") - F.col("mean")) / std, default).alias("z"),
        F.coalesce(-F.col("mean") / std, default).alias("zero_z"),
    )


def standardize(long: DataFrame) -> DataFrame:
    """``(id, feature, value)`` to zero mean and unit population std; constant features to 0."""
    stats = long.groupBy("feature").agg(
        F.avg("value").alias("m"), F.stddev_pop("value").alias("s")
    )
    std = F.when(F.col("s") > 0, F.col("s")).otherwise(F.lit(1.0))
    return long.join(stats, "feature").select(
        "id", "feature", ((F.col("value") - F.col("m")) / std).alias("value")
    )


def min_max_fit(long: DataFrame, feature: str = "feature", n_rows: Column | None = None) -> DataFrame:
    """Lowest and highest value per feature; with ``n_rows`` absent entries count as zero."""
    fit = long.groupBy(feature).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")
    )
    if n_rows is not None:
        absent = F.col("n") < n_rows
        fit = fit.select(
            feature,
            F.when(absent, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("lo"),
            F.when(absent, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("hi"),
        )
    return fit.select(feature, "lo", "hi")


def min_max_apply(
    long: DataFrame, fit: DataFrame, feature: str = "feature", top: float = 10.0
) -> DataFrame:
    width = F.col("hi") - F.col("lo")
    width = F.when(width == 0, F.lit(1.0)).otherwise(width)
    scaled = (F.col("value") - F.col("lo")) / width * top
    return long.join(fit, feature).withColumn("value", scaled).drop("lo", "hi")


def min_max_invert(
    long: DataFrame, fit: DataFrame, feature: str = "feature", top: float = 10.0
) -> DataFrame:
    width = F.col("hi") - F.col("lo")
    width = F.when(width == 0, F.lit(1.0)).otherwise(width)
    raw = F.col("value") / top * width + F.col("lo")
    return long.join(fit, feature).withColumn("value", raw).drop("lo", "hi")


def scale_coordinates(points: DataFrame, reference: DataFrame, axes: list[str]) -> DataFrame:
    """Min-max scale ``points`` with the range of ``reference``."""
    box = reference.agg(
        F.struct(*[F.min(a).alias(f"lo_{a}") for a in axes], *[F.max(a).alias(f"hi_{a}") for a in axes])
    ).scalar()
    out = points.withColumn("_box", box)
    for a in axes:
        width = F.col(f"_box.hi_{a}") - F.col(f"_box.lo_{a}")
        width = F.when(width == 0, F.lit(1.0)).otherwise(width)
        out = out.withColumn(a, (F.col(a) - F.col(f"_box.lo_{a}")) / width)
    return out.drop("_box")


def percentile_clip(df: DataFrame, value: str, perc: float, out: str = "shown") -> DataFrame:
    """Clip to the ``perc`` and ``1 - perc`` quantiles, then scale to 0..1."""
    bounds = quantiles(df, value, {"lo": perc, "hi": 1 - perc})
    both = bounds.select(F.struct("lo", "hi")).scalar()
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    clipped = F.least(F.greatest(F.col(value), lo), hi)
    shown = F.when(hi > lo, (clipped - lo) / (hi - lo))
    return df.withColumn("_b", both).withColumn(out, shown).drop("_b")


def rescale_to_totals(recon: DataFrame, raw: DataFrame) -> DataFrame:
    """Give a reconstruction each spot's raw total and round half to even."""
    got = library_sizes(recon).withColumnRenamed("n_umi", "got")
    want = library_sizes(raw).withColumnRenamed("n_umi", "want")
    return recon.join(got, "id").join(want, "id").select(
        "id", "gene", F.rint(F.col("value") / F.col("got") * F.col("want")).alias("value")
    )


def blend(raw: DataFrame, recon: DataFrame, alpha: float) -> DataFrame:
    """``(1 - alpha) * raw + alpha * recon`` over the union of stored entries."""
    a = raw.select("id", "gene", F.col("value").alias("_raw"))
    b = recon.select("id", "gene", F.col("value").alias("_rec"))
    zero = F.lit(0.0)
    return a.join(b, ["id", "gene"], "full_outer").select(
        "id", "gene",
        ((1 - alpha) * F.coalesce("_raw", zero) + alpha * F.coalesce("_rec", zero)).alias("value"),
    )
