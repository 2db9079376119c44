"""The three batch jobs: extract cell features, identify cell types, enhance expression.

Each stage is a function from tables to tables. Pass ``out`` to keep stage results as Parquet.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuegrid.functions.scalars import polygon_text
from tissuegrid.operators import assign as asg
from tissuegrid.operators import cvae, deconv, gat, impute
from tissuegrid.operators import geometry as ge
from tissuegrid.operators import graph as gr
from tissuegrid.operators import matrix as mx
from tissuegrid.operators import morphology as mo
from tissuegrid.operators import neighbors as nb
from tissuegrid.operators import normalize as nz
from tissuegrid.operators import propagate as lp
from tissuegrid.operators import rings as rg
from tissuegrid.operators import sampling, spots as sp
from tissuegrid.plans import state
from tissuegrid.session import materialize
from tissuegrid.sources import cells as src
from tissuegrid.sources.tables import write_table
from tissuegrid.store import settings_of

log = logging.getLogger("tissuegrid")

# Fixed defaults of the method.
UMI_MAX = 20_000_000
CELL_MIN = 25
MARKER_CUTS = {"bulk": (1.0, 2e-4), "reg": (1.25, 3e-4)}


# ---- features ----------------------------------------------------------------------------------

def extract_features(
    spark: SparkSession, geojson: str, patches: DataFrame | None = None, spots: DataFrame | None = None,
    lines: bool = False, out: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Cells ``(cell_id, x, y, circumcircle, polygon)`` and features ``(id, feature, value)``.

    ``patches`` limits cells to tissue, ``spots`` to the hull of the spots. Missing measurements
    take the mean of their feature; position and size count as features too.
    """
    raw = materialize(_largest_parts(materialize(src.read_geojson(spark, geojson, lines), "geojson")), "outlines")
    names = src.measurement_names(raw)
    at = lambda axis, f: f(F.transform("polygon", lambda p: p[axis]))
    centred = raw.select("*", ((at("x", F.array_min) + at("x", F.array_max)) / 2).alias("x"),
                         ((at("y", F.array_min) + at("y", F.array_max)) / 2).alias("y"))
    kept = ge.in_tissue(centred, patches)
    if spots is not None:
        kept = ge.inside_hull(kept, spots)
    cells = materialize(src.number_cells(kept, ["file", "pos"]), "cells")
    edges = ge.ring_edges(ge.explode_rings(cells))
    radius = ge.ring_radius(edges, ge.ring_measures(edges)).withColumnRenamed("radius", "circumcircle")
    table = cells.join(radius, "cell_id", "left").select("cell_id", "x", "y", "circumcircle", "polygon", "measurements")
    wanted = F.explode(F.array(*[F.lit(n) for n in names]))
    measured = table.select(F.col("cell_id").alias("id"), wanted.alias("feature"), "measurements").select(
        "id", "feature", F.try_element_at("measurements", F.col("feature")).alias("value"))
    placed = table.select(F.col("cell_id").alias("id"), "x", "y", F.col("circumcircle").alias("Circumcircle")).unpivot(
        "id", ["x", "y", "Circumcircle"], "feature", "value")
    features = mx.mean_fill(measured.unionByName(placed))
    if out:
        write_table(table.drop("measurements").withColumn("polygon_text", polygon_text(F.col("polygon"))), f"{out}/cells")
        write_table(features, f"{out}/features")
    return table.drop("measurements"), features


def _largest_parts(features: DataFrame) -> DataFrame:
    """Features with the outside of their largest part as ``polygon``, where there are several rings."""
    several = features.where(F.size("rings") > 1).select(F.struct("file", "pos").alias("cell_id"), "rings")
    vertices = materialize(rg.explode_outlines(several), "vertices")
    largest = rg.outside_rings(vertices, rg.outline_measures(vertices)).select(
        "cell_id.file", "cell_id.pos", F.col("polygon").alias("_largest"))
    return features.join(largest, ["file", "pos"], "left").withColumn(
        "polygon", F.coalesce("_largest", "polygon")).drop("_largest", "rings")


def boundary_table(cells: DataFrame, nuclei: DataFrame, probabilities: DataFrame | None = None) -> DataFrame:
    """One row per id of either vertex table ``(cell_id, ring, seq, x, y)``: measures of cell and nucleus outline.

    Position, ``circumcircle`` and ``polygon`` are those of the cell, or of the nucleus where there is no cell
    outline. Without a cell or nucleus outline its columns are null and the ratio of areas is 0; an id that
    the probabilities lack has 1.
    """
    both = cells.withColumn("kind", F.lit("cell")).unionByName(nuclei.withColumn("kind", F.lit("nucleus")))
    vertices = materialize(both.withColumn("cell_id", F.struct("cell_id", "kind")).drop("kind"), "vertices")
    outlines = materialize(rg.outline_measures(vertices), "measures")
    whole = outlines.join(rg.outside_rings(vertices, outlines), "cell_id").select(
        "cell_id.*", *(c for c in outlines.columns if c not in ("cell_id", "ring")), polygon_text(F.col("polygon")).alias("polygon"))
    names = [c for c in whole.columns if c not in ("cell_id", "kind")]
    side = lambda kind: F.first(F.when(F.col("kind") == kind, F.struct(*names)), ignorenulls=True).alias(kind)
    one = whole.groupBy("cell_id").agg(side("cell"), side("nucleus"))
    best = lambda c: F.coalesce(f"cell.{c}", f"nucleus.{c}")
    measures = ["area", "perimeter", "circularity", "n_parts", "n_holes", "total_area"]
    ratio = F.when(F.col("cell.area") > 0, F.col("nucleus.area") / F.col("cell.area"))
    table = one.select(
        "cell_id", best("centroid_x").alias("x"), best("centroid_y").alias("y"),
        *(F.col(f"{k}.{m}").alias(f"{k}_{m}") for k in ("cell", "nucleus") for m in measures),
        F.coalesce(ratio, F.lit(0.0)).alias("nucleus_cell_ratio"), best("radius").alias("circumcircle"), best("polygon").alias("polygon"))
    return src.with_probability(table, probabilities)


def extract_boundaries(
    spark: SparkSession, cells: str, nuclei: str, probabilities: str | None = None,
    alignment: Sequence[Sequence[float]] | None = None, scale: float = 1.0, ring: str | None = None, out: str | None = None,
) -> DataFrame:
    """Boundary files of cells and nuclei, brought to image space, as one table of outlines; kept under ``out``.

    ``alignment`` maps image to boundary positions and ``scale`` divides the latter first; ``ring`` names the
    column that numbers a cell's rings. A probability file without a known column counts as none.
    """
    read = lambda path: src.read_boundaries(spark, path, alignment, scale, ring)
    found = src.read_probabilities(spark, probabilities) if probabilities else None
    table = boundary_table(read(cells), read(nuclei), found)
    if out is None:
        return table
    write_table(table, f"{out}/boundaries")
    return spark.read.parquet(f"{out}/boundaries")


def extract_shapes(points: DataFrame, known: DataFrame) -> DataFrame:
    """Image mode: shape features of the point clouds whose cell is in the expression table."""
    kept = points.join(known.select(F.col("id").alias("cell_id")), "cell_id", "left_semi")
    wide = ge.shape_features(kept).withColumnRenamed("cell_id", "id")
    return mx.mean_fill(wide.unpivot("id", [c for c in wide.columns if c != "id"], "feature", "value"))


def feature_vectors(features: DataFrame) -> DataFrame:
    """Standardised features as one array per cell, in feature-name order."""
    scaled = nz.standardize(features)
    return scaled.groupBy("id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("feature", "value"))), lambda s: s["value"]).alias("v"))


# ---- identification ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Spatial:
    """Spot counts ``(id, gene, value)`` and positions ``(id, x, y[, z])``; cells where known."""

    counts: DataFrame
    spots: DataFrame
    diameter: float | None = None
    cells: DataFrame | None = None
    features: DataFrame | None = None
    assigned: DataFrame | None = None


@dataclass(frozen=True)
class Reference:
    counts: DataFrame
    types: DataFrame


@dataclass(frozen=True)
class Settings:
    image_mode: bool = False
    umi_min: float = 100
    umi_max: float = UMI_MAX
    umi_min_sigma: float = 300
    nu: float = 10.0
    n_neighbors: int = 10
    neighbor_mode: str = "radius"  # or "knn"
    # Bounds on work, each off unless asked for: cells per spot and per type, spots and entries of the sigma fit.
    max_cells: int | None = None
    reference_cells: int | None = None
    adapt_cells: int | None = None
    sigma_spots: int | None = None
    sigma_entries: int | None = None
    all_genes: bool = False
    drop_low: bool = False
    adapt: bool = True
    adapt_blend: float = 1.0
    cvae: cvae.CvaeConfig = field(default_factory=cvae.CvaeConfig)
    epochs: int = 8
    mcmc_iterations: int = 1500
    down_sample: float | None = None
    fill: str = "likelihood"
    fill_rounds: int = 100
    gat: gat.GatConfig = field(default_factory=gat.GatConfig)
    seed: int = 0


def load_counts(counts: DataFrame, markers: DataFrame | None = None, normalize: bool = False) -> DataFrame:
    """Marker filter, log back-transform, and library normalisation of matrices that were logged."""
    if markers is not None:
        counts = counts.join(markers.select("gene"), "gene", "left_semi")
    counts = materialize(counts, "counts")
    top = counts.agg(F.max("value")).first()[0]
    if top is None or top >= nz.LOG_SCALE_MAX:
        return counts
    raw = counts.withColumn("value", F.expm1("value"))
    return materialize(nz.library_normalize(raw) if normalize else raw, "counts")


@dataclass(frozen=True)
class Warm:
    """Result of the spot-level fit."""

    counts: DataFrame
    sizes: DataFrame
    genes: DataFrame
    profiles: DataFrame
    shapes: deconv.Profiles
    spots: DataFrame
    fitted: DataFrame
    sigma: int


def gene_lists(profiles, counts, all_genes: bool, markers: DataFrame | None) -> dict[str, DataFrame]:
    """Search genes for the regression and the bulk fit."""
    if markers is not None:
        return {"bulk": markers.select("gene"), "reg": markers.select("gene")}
    measured = counts.select("gene").distinct()
    if all_genes:
        common = measured.join(profiles.select("gene").distinct(), "gene")
        found = {"bulk": common, "reg": common}
    else:
        bulk = mx.bulk_vector(counts)
        n_types = profiles.select("cell_type").distinct().count()
        found = {k: mx.gene_union(mx.marker_genes(profiles, bulk, n_types, fold, level, 3))
                 for k, (fold, level) in MARKER_CUTS.items()}
    found = {k: materialize(v, f"genes-{k}") for k, v in found.items()}
    for name, genes in found.items():
        if genes.limit(1).count() == 0:
            raise ValueError(f"no {name} genes found")
    return found


def _bounded(types: DataFrame, n: int | None, seed: int) -> DataFrame:
    """All cells, or at most ``n`` of each type where a bound is asked for."""
    return types if n is None else sampling.sample_per_class(types, n, seed)


def warm_start(
    spatial: Spatial, reference: Reference, settings: Settings, markers: DataFrame | None = None, out: str | None = None,
    resume: bool = False,
) -> Warm:
    """The spot-level fit. It is kept under ``out``; ``resume`` takes what an earlier run with these settings left there."""
    spark, path = spatial.counts.sparkSession, f"{out}/warm" if out else None
    if state.have(spark, path, state.WARM, resume):
        return state.load_warm(spark, path, settings_of(settings))
    counts, sizes = spatial.counts, materialize(mx.library_sizes(spatial.counts), "sizes")
    mx.check_barcodes(spatial.spots, counts, sizes)
    types = _bounded(reference.types, settings.reference_cells, settings.seed)
    for row in mx.type_counts(types, CELL_MIN).where("NOT enough").collect():
        log.warning("cell type %s has %d cells, fewer than %d", row["cell_type"], row["n_cells"], CELL_MIN)
    profiles = materialize(mx.type_profiles(reference.counts, types), "profiles")
    kept = mx.restrict_counts(counts, sizes, None, settings.umi_min, settings.umi_max).drop("n_umi")
    lists = gene_lists(profiles, kept, settings.image_mode or settings.all_genes, markers)
    puck = materialize(kept.join(lists["bulk"], "gene", "left_semi"), "puck")
    sizes = sizes.join(puck.select("id").distinct(), "id", "left_semi")
    if settings.drop_low:
        puck = mx.keep_top_share(puck, lists["bulk"].count(), sizes.count())
    if settings.adapt:
        puck = _balance(puck, reference, types, lists["bulk"], settings, out, resume)
    puck = materialize(puck, "puck")
    bulk = materialize(mx.bulk_vector(puck), "bulk")
    total = sizes.agg(F.sum("n_umi"))
    design = mx.bulk_design(profiles, bulk, total, lists["bulk"])
    proportions = deconv.fit_bulk(design, total.first()[0])
    renormed = materialize(mx.renormalized_profiles(
        profiles.join(lists["bulk"], "gene", "left_semi"), bulk, total, proportions), "renormed")
    axis = impute.gene_axis(lists["reg"])
    spots = materialize(deconv.spot_rows(puck, sizes, axis), "spots")
    shapes = deconv.Profiles(renormed, axis)
    sigma = deconv.choose_sigma(spots, shapes, settings.umi_min_sigma, settings.sigma_spots, settings.sigma_entries, seed=settings.seed)
    fitted = materialize(deconv.fit_spots(spots, shapes, sigma), "fitted")
    warm = Warm(puck, sizes, lists["reg"], profiles, shapes, spots, fitted, sigma)
    if out is None:
        return warm
    state.save_warm(spark, path, warm, settings_of(settings))
    return state.load_warm(spark, path)


def _balance(puck, reference, types, genes, settings: Settings, out: str | None, resume: bool) -> DataFrame:
    """Platform correction: replace spot counts by their reconstruction on the reference platform."""
    scale = 1e3 if settings.image_mode else 1e4
    few = _bounded(types, settings.adapt_cells, settings.seed)
    sc = reference.counts.join(few.select("id"), "id", "left_semi").join(genes, "gene", "left_semi")
    axis = impute.gene_axis(genes)
    config = settings.cvae
    if settings.image_mode:
        config = replace(config, st_mix=(config.st_mix[0], config.sc_mix[1]))
    n_types = types.select("cell_type").distinct().count()
    spark, path, st = puck.sparkSession, f"{out}/autoencoder" if out else None, nz.fraction_scale(puck, scale)
    if state.have(spark, path, state.AUTOENCODER, resume):
        # The stored axis is the one the parameters belong to.
        model, axis = state.load_autoencoder(spark, path, config)
        rebuilt = cvae.reconstruct(impute.dense_vectors(st, axis), model, "st")
    else:
        model, rebuilt, _ = cvae.adapt_domains(st, nz.fraction_scale(sc, scale), axis, n_types, config)
        if path:
            state.save_autoencoder(spark, path, model, axis)
    long = rebuilt.select("id", F.posexplode("v").alias("ix", "value")).join(axis, "ix").select("id", "gene", "value")
    recon = nz.rescale_to_totals(materialize(long, "recon"), puck)
    out = recon if settings.adapt_blend >= 1 else nz.blend(puck, recon, settings.adapt_blend)
    return out.where("value > 0")


def cell_graph(cells: DataFrame, settings: Settings, axes: list[str]) -> DataFrame:
    """Neighbour edges as the settings ask: k nearest, or within a Manhattan radius that gives about as many."""
    if settings.neighbor_mode not in ("knn", "radius"):
        raise ValueError(f"unknown neighbor_mode {settings.neighbor_mode}")
    if settings.neighbor_mode == "knn":
        return gr.knn_edges(cells, axes, settings.n_neighbors).select("src", "dst")
    radius = nb.pair_distance_quantile(cells, axes, settings.n_neighbors / cells.count())
    return nb.radius_neighbors(cells, axes, radius).select(F.col("query_id").alias("src"), F.col("ref_id").alias("dst"))


@dataclass(frozen=True)
class Identified:
    labels: DataFrame
    all_labels: DataFrame
    overlap: DataFrame
    types: list[str]
    sigma: int
    beta: np.ndarray | None
    warm: Warm


def identify_cells(
    spatial: Spatial, reference: Reference, settings: Settings | None = None, markers: DataFrame | None = None,
    warm: Warm | None = None, out: str | None = None, resume: bool = False,
) -> Identified:
    """Labels of every cell. A given ``warm`` start is used as it is.

    With ``out`` the spot fit, the models and the result are kept there. ``resume`` starts from the last of
    them that is complete; results of other settings are refused.
    """
    s = settings or Settings()
    spark, path = spatial.counts.sparkSession, f"{out}/identified" if out else None
    if state.have(spark, path, state.IDENTIFIED, resume):
        return state.load_identified(spark, path, warm or state.load_warm(spark, f"{out}/warm"), settings_of(s))
    axes = ["x", "y", "z"] if "z" in spatial.spots.columns else ["x", "y"]
    if s.down_sample:
        n = int(spatial.spots.count() * s.down_sample)
        picked = sampling.farthest_points(gr.points(spatial.spots, axes), n)
        keep = picked.select("id")
        spatial = replace(spatial, spots=spatial.spots.join(keep, "id", "left_semi"),
                          counts=spatial.counts.join(keep, "id", "left_semi"))
    warm = warm or warm_start(spatial, reference, s, markers, out, resume)
    spots = spatial.spots.withColumnRenamed("id", "spot_id")
    if s.image_mode:
        overlap = spots.select("spot_id", F.col("spot_id").alias("cell_id"), F.lit(1.0).alias("frac"))
        cells = spatial.spots
    else:
        edges = ge.ring_edges(ge.explode_rings(spatial.cells))
        if spatial.assigned is not None:
            overlap = sp.overlap_from_assignment(spatial.assigned, spots, edges, spatial.diameter, s.max_cells, s.seed)
        else:
            placed = spatial.cells.withColumn("radius", F.coalesce("circumcircle", F.lit(0.0)))
            overlap = sp.overlap_matrix(placed, spots, edges, spatial.diameter, s.max_cells, s.seed)
        cells = spatial.cells.withColumnRenamed("cell_id", "id")
    overlap = overlap.join(warm.spots.select(F.col("id").alias("spot_id")), "spot_id", "left_semi")
    overlap = materialize(overlap.select("spot_id", "cell_id", "frac"), "overlap")
    inside = cells.join(overlap.select(F.col("cell_id").alias("id")), "id", "left_semi")
    graph = cell_graph(materialize(inside.select("id", *axes), "inside"), s, axes)
    vectors = None
    if spatial.features is not None:
        vectors = materialize(feature_vectors(spatial.features), "vectors")
        graph = gr.edge_cosine(graph, vectors)
    else:
        graph = graph.withColumn("weight", F.lit(1.0))
    labels, sigma, effects = asg.identify_cells(
        warm.spots, warm.fitted, warm.shapes, warm.sigma, overlap, materialize(graph, "graph"), vectors, s.nu,
        s.epochs, s.umi_min_sigma, mcmc_iterations=s.mcmc_iterations, seed=s.seed)
    every = labels if s.image_mode else materialize(
        fill_up(cells, labels, vectors, axes, len(warm.shapes.types), s, out, resume), "all")
    names = F.array(*[F.lit(t) for t in warm.shapes.types])
    named = lambda d: d.withColumn("cell_type", F.element_at(names, (F.col("label") + 1).cast("int")))
    result = Identified(named(labels), named(every), overlap, warm.shapes.types, sigma,
                        None if effects is None else effects[0], warm)
    if out is None:
        return result
    state.save_identified(spark, path, result, settings_of(s))
    state.export_labels(result, spatial.features, out)
    return state.load_identified(spark, path, warm)


def fill_up(cells, labels, vectors, axes, n_types: int, s: Settings, out: str | None = None, resume: bool = False) -> DataFrame:
    """Labels for cells outside all spots: propagation with a likelihood pass, or graph attention."""
    if s.fill not in ("likelihood", "attention"):
        raise ValueError(f"unknown fill {s.fill}")
    near = materialize(gr.knn_edges(cells, axes, s.n_neighbors).select("src", "dst"), "near")
    if s.fill == "attention":
        nodes = gat.with_order(cells.select("id", "x", "y")).join(vectors, "id").join(labels, "id", "left")
        spark, path, known = cells.sparkSession, f"{out}/attention" if out else None, None
        if state.have(spark, path, state.ATTENTION, resume):
            known = state.load_attention(spark, path, s.gat)[0]
        filled, params, losses = gat.fill_labels(nodes.select("id", "order", "v", "label"), near, n_types, s.gat, known)
        if path and known is None:
            state.save_attention(spark, path, params, s.gat, losses)
        return filled
    free = cells.select("id").join(labels, "id", "left_anti")
    drawn = sampling.initial_labels(free.withColumn("_none", F.lit(None).cast("long")), "_none", n_types, s.seed)
    mass = lp.one_hot_mass(labels.unionByName(drawn.select("id", "label")))
    spread = lp.top_label(lp.propagate(gr.symmetric(near), mass, s.fill_rounds, labels))
    spread = materialize(spread, "spread")
    if vectors is None:
        return spread
    weighted = gr.edge_cosine(near, vectors).withColumn("weight", F.exp("weight"))
    return lp.refine(weighted, spread, labels)


# ---- enhancement ---------------------------------------------------------------------------------

def enhance_from_spots(
    spatial: Spatial, reference: Reference, found: Identified, k: int = 50, balance: bool = True,
    sample: tuple[int, int] | None = None, seed: int = 0, out: str | None = None,
) -> DataFrame:
    """Whole-transcriptome counts ``(id, gene, value)`` for every cell of the slide.

    ``sample`` (limit, n) cuts every class of the reference to n cells once one exceeds the limit.
    """
    types = reference.types if sample is None else sampling.sample_if_large(reference.types, *sample, seed)
    refs = materialize(reference.counts.join(types.select("id"), "id", "left_semi"), "refs")
    cells = found.all_labels.select("id", "cell_type")
    signature = cells.join(found.warm.profiles.join(found.warm.genes, "gene", "left_semi"), "cell_type")
    if found.beta is not None and spatial.features is not None:
        axis = found.warm.shapes.axis
        effect = mo.factors(feature_vectors(spatial.features), found.beta).select(
            "id", F.posexplode("factor").alias("ix", "factor")).join(axis, "ix").select("id", "gene", "factor")
        signature = signature.join(effect, ["id", "gene"]).withColumn("mean", F.col("mean") * F.col("factor"))
    common = refs.select("gene").distinct().join(spatial.counts.select("gene").distinct(), "gene")
    imputed = impute.impute_in_class(
        signature.select("id", "gene", F.col("mean").alias("value")), cells, refs, types, found.warm.genes, k, common)
    if balance:
        imputed = materialize(imputed, "imputed")
        kernel = impute.kernel_expression(
            spatial.cells.withColumnRenamed("cell_id", "id"), spatial.spots,
            spatial.counts.join(common, "gene", "left_semi"))
        imputed = impute.spatial_balance(imputed, kernel)
    if out:
        write_table(imputed, f"{out}/expression")
    return imputed


def enhance_from_image(
    spatial: Spatial, reference: Reference, labels: DataFrame, model: cvae.Cvae, axis: DataFrame,
    subclass_map: DataFrame | None = None, k: int = 50, normalize_measured: bool = False, out: str | None = None,
) -> DataFrame:
    """Image mode: search in the shared reconstruction space; measured genes keep their values.

    ``model`` is a trained autoencoder over ``axis``; its input scaling is refitted on the z-scores.
    """
    sc = materialize(nz.log_per_million(reference.counts), "sc")
    st = materialize(nz.log_to_median(spatial.counts), "st")
    zq = materialize(impute.zscore_vectors(st, axis), "zscores")
    zr = materialize(impute.zscore_vectors(sc, axis), "zscores")
    model = replace(model, config=replace(model.config, log=False),
                    scale_st=cvae.vector_scale(zq), scale_sc=cvae.vector_scale(zr))
    q, r = cvae.reconstruct(zq, model, "st"), cvae.reconstruct(zr, model, "sc")
    predicted = impute.impute_from_image(
        q, labels.select("id", "cell_type"), r, reference.types, sc, subclass_map, k)
    measured = st if normalize_measured else spatial.counts
    genes = spatial.counts.select("gene").distinct()
    # Drop predictions of measured genes, so that a measured zero stays a zero.
    result = predicted.join(genes, "gene", "left_anti").unionByName(measured.select("id", "gene", "value"))
    if out:
        write_table(result, f"{out}/expression")
    return result


# ---- several sections ------------------------------------------------------------------------------

def transfer_sections(
    cells: DataFrame, features: DataFrame, base: list[int], groups: dict[int, list[int]], config: gat.GatConfig | None = None,
    smooth_rounds: int = 10, k: int = 10,
) -> DataFrame:
    """Carry labels from labelled base sections to the sections of their group.

    ``cells(id, section, x, y, z, label, cell_type)`` where ``label`` is the region and
    ``cell_type`` an integer class; ``groups`` maps a base section to the sections it serves.
    """
    axes = ["x", "y", "z"]
    n_types = cells.agg(F.max("cell_type") + 1).first()[0]
    labelled = cells.where(F.col("section").isin(base))
    edges = gr.slice_edges(labelled.select("id", *axes, "label", "section"), axes, k, by="section")
    smooth = materialize(lp.smooth_labels(edges, labelled.select("id", F.col("cell_type").cast("long").alias("label")), smooth_rounds), "smooth")
    out = None
    for start, served in groups.items():
        order = sorted({start, *served})
        rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("section")) - 1
        group = cells.where(F.col("section").isin(order)).withColumn("slice_rank", rank)
        known = group.where(F.col("section") == start).select("id").join(smooth.withColumnRenamed("label", "known"), "id")
        net = materialize(gr.stacked_edges(group, axes, k), "stack")
        nodes = gat.with_order(group.select("id", "x", "y")).join(feature_vectors(features), "id").join(known, "id", "left")
        found, _, _ = gat.fill_labels(
            nodes.select("id", "order", "v", F.col("known").alias("label")), net, n_types,
            config or gat.GatConfig(lr=0.001))
        out = found if out is None else out.unionByName(found)
    return out
