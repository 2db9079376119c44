"""Tables behind the figures, and small ordering helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuegrid.functions.scalars import natural_key
from tissuegrid.operators.normalize import percentile_clip
from tissuegrid.operators.ranking import row_numbers


def in_box(df: DataFrame, x_min: float, x_max: float, y_min: float, y_max: float) -> DataFrame:
    """Open interval in both axes."""
    return df.where(
        (F.col("x") > x_min) & (F.col("x") < x_max) & (F.col("y") > y_min) & (F.col("y") < y_max)
    )


def null_other_labels(df: DataFrame, column: str, keep: Sequence) -> DataFrame:
    """Keep every row but blank labels outside the subset."""
    return df.withColumn(column, F.when(F.col(column).isin(list(keep)), F.col(column)))


def gene_layer(counts: DataFrame, spots: DataFrame, gene, perc: float = 0.0) -> DataFrame:
    """One gene over all spots (absent means zero), clipped and scaled to 0..1 for display."""
    picked = counts.where(F.col("gene") == gene).select("id", "value")
    dense = spots.join(picked, "id", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return percentile_clip(dense, "value", perc)


def proportion_layer(spots: DataFrame, shares: DataFrame, region: str | None = None) -> DataFrame:
    """Spots with their shares; circles of one region only where asked."""
    joined = spots.join(shares, "id", "left")
    return joined if region is None else joined.where(F.col("region") == region)


def cell_layer(cells: DataFrame, label: str, subset: Sequence | None = None,
               box: tuple[float, float, float, float] | None = None) -> DataFrame:
    out = cells if box is None else in_box(cells, *box)
    return out if subset is None else null_other_labels(out, label, subset)


def shapes_with_label(shapes: DataFrame, label: str) -> DataFrame:
    return shapes.where(F.col("label") == label)


def top_interactions(scores: DataFrame, senders: DataFrame, receivers: DataFrame, k: int = 100) -> DataFrame:
    """Highest ``scores(pair, score)`` between given cells; ``pair`` reads ``sender/receiver``."""
    parts = F.split("pair", "/")
    split = scores.withColumn("_a", parts[0]).withColumn("_b", parts[1])
    located = (
        split.join(senders.withColumnRenamed("cell", "_a"), "_a")
        .join(receivers.withColumnRenamed("cell", "_b"), "_b")
    )
    return located.orderBy(F.col("score").desc(), "pair").limit(k).drop("_a", "_b")


def first_positions(seq: DataFrame) -> DataFrame:
    """Distinct ids with the position at which each first occurs: sort by it for a stable dedupe."""
    return seq.groupBy("id").agg(F.min("pos").alias("first_pos"))


def natural_positions(names: DataFrame) -> DataFrame:
    """Rank distinct names in human order (``g2`` before ``g10``)."""
    return row_numbers(names.withColumn("_key", natural_key(F.col("name"))),
                       [F.col("_key"), F.col("name")], "pos").select("name", "pos")
