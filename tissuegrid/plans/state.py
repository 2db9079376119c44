"""Stage results as bundles, so that a run can go on where another ended."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuegrid.operators import cvae, deconv, gat
from tissuegrid.sources.tables import write_csv
from tissuegrid.store import Bundle, holds, load, save, settings_as, settings_of

WARM, IDENTIFIED, AUTOENCODER, ATTENTION = "warm start", "identified cells", "autoencoder", "attention net"
_WARM_TABLES = ("counts", "sizes", "genes", "profiles", "spots", "fitted")


def require_settings(stored: dict, wanted: dict, path: str) -> None:
    """Stored results only stand in for a run with the same settings."""
    names = sorted(k for k in {*stored, *wanted} if _plain(stored.get(k)) != _plain(wanted.get(k)))
    if names:
        raise ValueError(f"{path} was made with other settings: {', '.join(names)}")


def _plain(value):
    """Settings as they come back from JSON."""
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return {k: _plain(v) for k, v in value.items()} if isinstance(value, dict) else value


# ---- warm start ------------------------------------------------------------------------------

def save_warm(spark: SparkSession, path: str, warm, settings: dict | None = None) -> None:
    tables = {t: getattr(warm, t) for t in _WARM_TABLES}
    save(spark, path, Bundle(WARM, {**tables, "axis": warm.shapes.axis}, {"matrix": warm.shapes.matrix},
                             {"types": list(warm.shapes.types), "sigma": int(warm.sigma), "settings": settings or {}}))


def load_warm(spark: SparkSession, path: str, settings: dict | None = None):
    """A ``Warm`` start; with ``settings`` it must have been made with the same."""
    from tissuegrid.plans.workflow import Warm

    b = load(spark, path, WARM)
    if settings is not None:
        require_settings(b.values["settings"], settings, path)
    shapes = deconv.Profiles.stored(b.arrays["matrix"], b.values["types"], b.tables["axis"])
    return Warm(*(b.tables[t] for t in ("counts", "sizes", "genes", "profiles")), shapes, b.tables["spots"], b.tables["fitted"],
                b.values["sigma"])


# ---- identified cells --------------------------------------------------------------------------

def save_identified(spark: SparkSession, path: str, found, settings: dict | None = None) -> None:
    """Labels, overlap and effects; the warm start is a bundle of its own."""
    arrays = {} if found.beta is None else {"beta": np.asarray(found.beta)}
    save(spark, path, Bundle(
        IDENTIFIED, {"labels": found.labels, "all_labels": found.all_labels, "overlap": found.overlap}, arrays,
        {"types": list(found.types), "sigma": int(found.sigma), "settings": settings or {}}))


def load_identified(spark: SparkSession, path: str, warm, settings: dict | None = None):
    from tissuegrid.plans.workflow import Identified

    b = load(spark, path, IDENTIFIED)
    if settings is not None:
        require_settings(b.values["settings"], settings, path)
    return Identified(b.tables["labels"], b.tables["all_labels"], b.tables["overlap"], b.values["types"], b.values["sigma"],
                      b.arrays.get("beta"), warm)


def export_labels(found, features: DataFrame | None, out: str) -> None:
    """Labels ``(id, cell_type)`` and, where there are effects, ``(feature, gene, value)`` as CSV files."""
    write_csv(found.all_labels.select("id", "cell_type"), f"{out}/labels_csv")
    if found.beta is None or features is None:
        return
    spark = found.labels.sparkSession
    # Effects follow the feature names in order and the gene axis; both are bounded by the model.
    names = [r["feature"] for r in features.select("feature").distinct().orderBy("feature").collect()]
    rows = [(n, v.tolist()) for n, v in zip(names, np.asarray(found.beta))]
    effects = spark.createDataFrame(rows, "feature string, v array<double>").select("feature", F.posexplode("v").alias("ix", "value"))
    write_csv(effects.join(found.warm.shapes.axis, "ix").select("feature", "gene", "value"), f"{out}/factors_csv")


# ---- models ------------------------------------------------------------------------------------

def save_autoencoder(spark: SparkSession, path: str, model: cvae.Cvae, axis: DataFrame | None = None) -> None:
    arrays = {**{f"p.{k}": v for k, v in model.params.items()}, **{f"r.{k}": v for k, v in model.running.items()}}
    for name in ("scale_sc", "scale_st"):
        if getattr(model, name) is not None:
            arrays |= {f"{name}.{i}": np.asarray(v) for i, v in enumerate(getattr(model, name))}
    save(spark, path, Bundle(AUTOENCODER, {} if axis is None else {"axis": axis}, arrays, {
        "config": settings_of(model.config), "genes": int(model.genes), "latent": int(model.latent),
        "losses": [float(x) for x in model.losses]}))


def load_autoencoder(spark: SparkSession, path: str, config: cvae.CvaeConfig | None = None) -> tuple[cvae.Cvae, DataFrame | None]:
    """The trained model and the gene axis it was trained on; with ``config`` it must have been trained by that."""
    b = load(spark, path, AUTOENCODER)
    if config is not None:
        require_settings(b.values["config"], settings_of(config), path)
    part = lambda mark: {k[2:]: v for k, v in b.arrays.items() if k.startswith(mark)}
    scale = lambda name: (b.arrays[f"{name}.0"], b.arrays[f"{name}.1"]) if f"{name}.0" in b.arrays else None
    model = cvae.Cvae(settings_as(cvae.CvaeConfig, b.values["config"]), b.values["genes"], b.values["latent"], part("p."), part("r."),
                      scale("scale_sc"), scale("scale_st"), b.values["losses"])
    return model, b.tables.get("axis")


def save_attention(spark: SparkSession, path: str, params: dict[str, np.ndarray], config: gat.GatConfig, losses: list[float]) -> None:
    save(spark, path, Bundle(ATTENTION, {}, params, {"config": settings_of(config), "losses": [float(x) for x in losses]}))


def load_attention(spark: SparkSession, path: str, config: gat.GatConfig | None = None) -> tuple[dict[str, np.ndarray], gat.GatConfig, list[float]]:
    b = load(spark, path, ATTENTION)
    if config is not None:
        require_settings(b.values["config"], settings_of(config), path)
    return b.arrays, settings_as(gat.GatConfig, b.values["config"]), b.values["losses"]


def have(spark: SparkSession, path: str | None, kind: str, resume: bool) -> bool:
    return resume and path is not None and holds(spark, path, kind)
