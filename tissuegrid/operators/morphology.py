"""Effect of cell features on expression: spike-and-slab Metropolis sampling over all spots.

The chain state (features x genes) is bounded and lives on the driver. Each proposal is scored
by one job over the spot blocks, wherever they are, that returns one sum per gene; nothing that
grows with the number of cells is collected or broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuegrid.functions import likelihood as lk
from tissuegrid.session import materialize

FACTOR_MAX = 5.0
SLAB = 1.0
PROPOSAL = 0.5
KEEP_SHARE = {"joint": 0.05, "single": 0.1}


def spot_blocks(base: DataFrame, overlap: DataFrame, labels: DataFrame, features: DataFrame) -> DataFrame:
    """``(spot_id, v, size, cells)``: a spot with its capped list of cells."""
    cells = overlap.withColumnRenamed("cell_id", "id").join(labels, "id").join(
        features.withColumnRenamed("v", "x"), "id")
    packed = cells.groupBy("spot_id").agg(
        F.sort_array(F.collect_list(F.struct("id", "frac", "label", "x"))).alias("cells"))
    return materialize(base.select("spot_id", "v", "size").join(packed, "spot_id"), "blocks")


def factors(features: DataFrame, beta: np.ndarray) -> DataFrame:
    """``(id, factor)``: clamped effect per gene for every cell."""
    shared = features.sparkSession.sparkContext.broadcast(beta)

    @F.pandas_udf("array<double>")
    def effect(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.clip(np.exp(np.stack(x.to_numpy()) @ shared.value), 0, FACTOR_MAX)))

    return features.select("id", effect("v").alias("factor"))


def _flatten(batch: pd.DataFrame):
    """Cells of a batch as flat arrays plus the index of their spot."""
    n = [len(c) for c in batch["cells"]]
    owner = np.repeat(np.arange(len(n)), n)
    rows = [c for cell_list in batch["cells"] for c in cell_list]
    frac = np.array([r["frac"] for r in rows])
    label = np.array([r["label"] for r in rows], int)
    return owner, frac, label, np.array([r["x"] for r in rows], float)


def gene_scores(blocks: DataFrame, model, betas: list[np.ndarray]) -> np.ndarray:
    """Negative log-likelihood per candidate coefficient matrix and gene: ``len(betas) x genes``."""
    shared = blocks.sparkSession.sparkContext.broadcast((model.matrix, model.table, model.grid, betas))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, table, grid, proposals = shared.value
        sums = np.zeros((len(proposals), len(matrix)))
        for batch in batches:
            owner, frac, label, x = _flatten(batch)
            y = np.stack(batch["v"].to_numpy())
            cover = np.bincount(owner, frac, len(batch))
            share = frac * (batch["size"].to_numpy() / np.where(cover > 0, cover, 1.0))[owner]
            for i, beta in enumerate(proposals):
                part = matrix.T[label] * np.clip(np.exp(x @ beta), 0, FACTOR_MAX) * share[:, None]
                rate = np.zeros_like(y, dtype=float)
                np.add.at(rate, owner, part)
                sums[i] -= np.log(lk.probability(rate, y, table, grid)).sum(0)
        which, gene = np.indices(sums.shape)
        yield pd.DataFrame({"which": which.ravel(), "gene": gene.ravel(), "nll": sums.ravel()})

    rows = blocks.select("v", "size", "cells").mapInPandas(score, "which int, gene int, nll double").groupBy(
        "which", "gene").agg(F.sum("nll").alias("nll")).toPandas()
    out = np.zeros((len(betas), len(model.matrix)))
    out[rows["which"], rows["gene"]] = rows["nll"]
    return out


def sample_effects(
    blocks: DataFrame, model, start=None, iterations: int = 1500, burn: int | None = None,
    slab: float = SLAB, seed: int = 0, moves: str = "joint",
) -> tuple[np.ndarray, np.ndarray]:
    """Posterior means of the coefficients and their inclusion.

    Each coefficient is zero, or normal of width ``slab``, with even odds a priori. A step touches one
    feature (``"single"``, in turn) or all of them (``"joint"``). A touched coefficient that is zero
    gets a draw from the slab (birth); another is set to zero (death) or moved (walk), each half of
    the time. Genes do not share coefficients, so every gene accepts or rejects its whole step by its
    own likelihood, and the state it keeps is the state that was scored: one job per step.
    Rarely included coefficients are set to zero at the end.
    """
    if moves not in KEEP_SHARE:
        raise ValueError(f"unknown moves {moves}")
    rng = np.random.default_rng(seed)
    if start is None:
        n_features = len(blocks.select(F.col("cells")[0]["x"].alias("x")).first()["x"])
        beta = np.zeros((n_features, len(model.matrix)))
    else:
        beta = start[0].copy()
    burn = iterations // 2 if burn is None else burn
    sums, flags, kept = np.zeros_like(beta), np.zeros_like(beta), 0
    current = gene_scores(blocks, model, [beta])[0]
    for step in range(iterations):
        touched = np.ones(beta.shape, bool) if moves == "joint" else np.arange(len(beta))[:, None] == step % len(beta)
        trial, log_ratio = propose(beta, np.broadcast_to(touched, beta.shape), slab, rng)
        scored = gene_scores(blocks, model, [trial])[0]
        accept = np.log(rng.random(beta.shape[1])) < current - scored + log_ratio
        beta, current = np.where(accept, trial, beta), np.where(accept, scored, current)
        if step >= burn:
            kept += 1
            sums += beta
            flags += beta != 0
    mean, share = sums / max(kept, 1), flags / max(kept, 1)
    included = share >= KEEP_SHARE[moves]
    return np.where(included, mean, 0.0), included.astype(int)


def propose(beta: np.ndarray, touched: np.ndarray, slab: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """Candidate coefficients and, per gene, the log ratio of prior and proposal densities.

    A birth draws from the slab itself, so the densities cancel and the odds of choosing its reverse,
    one half, remain; a death is its mirror image; a walk leaves the ratio of the slab's densities.
    """
    birth = touched & (beta == 0)
    death = touched & (beta != 0) & (rng.random(beta.shape) < 0.5)
    walk = touched & (beta != 0) & ~death
    trial = np.where(birth, rng.normal(0.0, slab, beta.shape), beta)
    trial = np.where(death, 0.0, trial)
    trial = np.where(walk, beta + rng.normal(0.0, PROPOSAL, beta.shape), trial)
    walked = np.where(walk, (beta * beta - trial * trial) / (2 * slab * slab), 0.0)
    return trial, (walked + math.log(0.5) * birth - math.log(0.5) * death).sum(axis=0)
