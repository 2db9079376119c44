"""Label propagation on edge tables. Label mass is ``(id, label, p)`` with zero entries absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.session import materialize, release

EPS = 1e-12
ROUNDS_PER_STAGE = 4


def one_hot_mass(labels: DataFrame) -> DataFrame:
    return labels.select("id", "label", F.lit(1.0).alias("p"))


def uniform_mass(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Every label with equal mass; classes are a short list, kept as one array per node."""
    listed = classes.agg(F.sort_array(F.collect_set("label"))).scalar()
    return nodes.select("id", F.explode(listed).alias("label")).withColumn(
        "p", F.lit(1.0) / F.size(listed))


def _spread(edges: DataFrame, mass: DataFrame) -> DataFrame:
    return (
        edges.join(mass.withColumnRenamed("id", "dst"), "dst")
        .groupBy(F.col("src").alias("id"), "label").agg(F.sum(F.col("weight") * F.col("p")).alias("p"))
    )


def _row_normalize(mass: DataFrame, eps: float) -> DataFrame:
    total = F.sum("p").over(Window.partitionBy("id"))  # one row per label of the node
    return mass.select("id", "label", F.try_divide(F.col("p"), total + F.lit(eps)).alias("p"))


def propagate(
    edges: DataFrame, mass: DataFrame, rounds: int, clamped: DataFrame | None = None, eps: float = EPS,
    normalize: bool = True,
) -> DataFrame:
    """``rounds`` of neighbour sums; nodes in ``clamped`` return to their starting mass each round.

    What a clamped node would receive is never used, so its incoming edges are dropped up front.
    """
    e = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    e = e.select("src", "dst", "weight")
    held = None
    if clamped is not None:
        held = materialize(mass.join(clamped.select("id"), "id", "left_semi"), "clamped")
        e = e.join(clamped.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst", "weight")
    e = materialize(e, "edges")
    stage = None
    for i in range(rounds):
        mass = _spread(e, mass)
        if normalize:
            mass = _row_normalize(mass, eps)
        if held is not None:
            mass = mass.unionByName(held)
        if (i + 1) % ROUNDS_PER_STAGE == 0 and i + 1 < rounds:
            fresh = materialize(mass, "mass")
            if stage is not None:
                release(stage)
            mass = stage = fresh
    return mass


def top_label(mass: DataFrame) -> DataFrame:
    """Label with the largest mass; ties take the lowest label."""
    return mass.groupBy("id").agg(
        F.min_by("label", F.struct((-F.round("p", 12)).alias("p"), F.col("label"))).alias("label"))


def refine(edges: DataFrame, labels: DataFrame, clamped: DataFrame) -> DataFrame:
    """One simultaneous pass over free nodes: the label with the least weighted disagreement.

    The cost of label c is proportional to the summed weight of neighbours labelled otherwise, so
    the best label is the one carrying the most neighbour weight; a label no neighbour has
    costs the whole sum. Neighbour weights are positive, hence only neighbour labels can win.
    """
    free = edges.join(clamped.select(F.col("id").alias("src")), "src", "left_anti")
    votes = free.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(
        F.col("src").alias("id"), "label").agg(F.sum("weight").alias("w"))
    best = votes.groupBy("id").agg(
        F.min_by("label", F.struct((-F.round("w", 10)).alias("w"), F.col("label"))).alias("_new"))
    return labels.join(best, "id", "left").select("id", F.coalesce("_new", "label").alias("label"))


def smooth_labels(edges: DataFrame, labels: DataFrame, rounds: int = 10) -> DataFrame:
    """Unclamped smoothing of one section; nodes that lose all mass keep their label."""
    mass = propagate(edges, one_hot_mass(labels), rounds, eps=0.0)
    found = top_label(mass).withColumnRenamed("label", "_new")
    return labels.join(found, "id", "left").select("id", F.coalesce("_new", "label").alias("label"))
