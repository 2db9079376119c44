"""Cell-type weights of spots by iteratively reweighted least squares on the count likelihood.

Spots are rows with a dense count array over the search genes; profiles (genes x types) and one
likelihood table travel to the tasks. Every spot is independent, so fitting is one map stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissuegrid.functions import likelihood as lk
from tissuegrid.operators.impute import dense_vectors, gene_axis
from tissuegrid.operators.ranking import hash_order
from tissuegrid.session import materialize, spread

DAMPING = 0.3
CURVATURE_FLOOR = 1e-3
RIDGE = 1e-7
START_SIGMA = 100
SIGMA_EPOCHS = 8
SIGMA_WINDOW = 8
#: Spots that are fitted together, and products of gene and type pairs that are held for them.
STACK, OUTER_CELLS = 256, 1 << 23
MULTIPLIERS = (0.8, 0.9, 1.0, 1.1, 1.2)


# ---- numeric helpers -------------------------------------------------------------------------

def stacked_nonnegative(d: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``argmin u'Du/2 - c'u`` over ``u >= 0`` by active sets for positive definite ``d (s, n, n)`` and ``c (s, n)``.

    Returns the minima and which of the problems settled. All problems keep their own active set; one batched solve moves every problem that is not done. Held
    coordinates are replaced by rows of the identity, so that all systems have one shape.
    """
    s, n = c.shape
    u, free = np.zeros((s, n)), np.zeros((s, n), bool)
    tol = 1e-12 * np.maximum(1.0, np.abs(c).max(axis=1))
    open_, done, added = np.ones(s, bool), np.zeros(s, bool), np.zeros(s, int)
    unit = np.eye(n)
    while True:
        # Problems whose last solve was inside: free the steepest coordinate or stop.
        at = np.flatnonzero(open_ & ~done)
        if len(at):
            slope = np.where(free[at], -np.inf, c[at] - np.einsum("sij,sj->si", d[at], u[at]))
            best = slope.argmax(axis=1)
            end = (slope[np.arange(len(at)), best] <= tol[at]) | (added[at] >= 5 * n)
            done[at[end]] = True
            at, best = at[~end], best[~end]
            free[at, best] = True
            added[at] += 1
        go = np.flatnonzero(~done)
        if not len(go):
            return u, added < 5 * n
        f = free[go]
        both = f[:, :, None] & f[:, None, :]
        trial = np.linalg.solve(np.where(both, d[go], unit), np.where(f, c[go], 0.0)[..., None])[..., 0]
        trial = np.where(f, trial, 0.0)
        bad = f & (trial <= 0)
        inside = ~bad.any(axis=1)
        u[go[inside]], open_[go[inside]] = trial[inside], True
        # The others go as far as the first coordinate that turns negative, and hold it at zero.
        cut = go[~inside]
        if len(cut):
            now, to = u[cut], trial[~inside]
            room = np.where(bad[~inside], now / np.maximum(now - to, 1e-300), np.inf).min(axis=1)
            u[cut] = np.maximum(now + room[:, None] * (to - now), 0.0)
            free[cut] &= u[cut] > 1e-15
            open_[cut] = ~free[cut].any(axis=1)


def _curvatures(matrix: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """``-M' diag(curve) M`` for each row of ``curve``."""
    genes, n = matrix.shape
    if genes * n * n <= OUTER_CELLS:
        outer = (matrix[:, :, None] * matrix[:, None, :]).reshape(genes, n * n)
        return -(curve @ outer).reshape(len(curve), n, n)
    return np.stack([-(matrix.T * row) @ matrix for row in curve])


def fit_stack(
    matrix: np.ndarray, size: np.ndarray, y: np.ndarray, table: np.ndarray | None, grid: np.ndarray | None,
    n_iter: int = 50, tol: float = 1e-3, constrain: bool = False,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights ``(s, n)``, steps and convergence of a stack of spots with counts ``y (s, genes)``.

    The design of a spot is ``matrix`` times its ``size``. Every spot takes the steps it would take alone;
    those that have settled leave the stack. A spot whose inner problem did not settle counts as not converged.
    Without a table the bulk loss ``(ln prediction - ln y)^2`` is used.
    """
    s, n = len(y), matrix.shape[1]
    weights = np.full((s, n), 1.0 / n)
    steps, converged, sound = np.full(s, n_iter), np.zeros(s, bool), np.ones(s, bool)
    floor = np.maximum(1e-4, size * 1e-7)
    at = np.arange(s)
    for i in range(1, n_iter + 1):
        w = np.maximum(weights[at], 0.0)
        scale_by = size[at][:, None]
        pred = np.maximum(np.abs(w @ matrix.T) * scale_by, floor[at][:, None])
        if table is None:
            gap = np.log(pred) - np.log(y[at])
            slope, curve = -2 * gap / pred, -2 * (1 - gap) / pred ** 2
        else:
            slope, curve = lk.log_derivatives(pred, y[at], table, grid)
        pull = (slope @ matrix) * scale_by
        values, vectors = np.linalg.eigh(_curvatures(matrix, curve * scale_by ** 2))
        values = np.maximum(values, CURVATURE_FLOOR)
        scale = values.max(axis=1)[:, None]
        d = (vectors * (values / scale)[:, None, :]) @ vectors.transpose(0, 2, 1) + RIDGE * np.eye(n)
        target = pull / scale + np.einsum("sij,sj->si", d, w)
        if constrain:
            # A strong penalty row for the sum, then exact rescaling.
            big = (1e4 * np.maximum(1.0, np.abs(d).max(axis=(1, 2))))[:, None]
            u, ok = stacked_nonnegative(d + big[..., None], target + big)
            total = u.sum(axis=1, keepdims=True)
            u = np.where(total > 0, u / np.where(total > 0, total, 1.0), u)
        else:
            u, ok = stacked_nonnegative(d, target)
        sound[at] &= ok
        step = DAMPING * (u - w)
        weights[at] = w + step
        near = np.abs(step).sum(axis=1) <= tol
        steps[at[near]], converged[at[near]] = i, True
        at = at[~near]
        if not len(at):
            break
    return weights, steps, converged & sound


# ---- inputs ----------------------------------------------------------------------------------

class Profiles:
    """Profile matrix on a gene axis: genes x types, a bounded table kept on the driver."""

    def __init__(self, profiles: DataFrame, axis: DataFrame):
        rows = profiles.join(axis, "gene").select("ix", "cell_type", "mean").toPandas()
        self.types = sorted(rows["cell_type"].unique())
        self.axis = axis
        self.matrix = np.zeros((axis.count(), len(self.types)))
        col = rows["cell_type"].map({t: i for i, t in enumerate(self.types)})
        self.matrix[rows["ix"], col] = rows["mean"]

    @classmethod
    def stored(cls, matrix: np.ndarray, types: list[str], axis: DataFrame) -> Profiles:
        """Profiles that were built before, from their parts."""
        self = cls.__new__(cls)
        self.matrix, self.types, self.axis = matrix, types, axis
        return self


def spot_rows(counts: DataFrame, sizes: DataFrame, axis: DataFrame) -> DataFrame:
    """``(id, n_umi, v)`` with counts over the axis; library sizes keep all genes."""
    return dense_vectors(counts, axis).join(sizes, "id").select("id", "n_umi", "v")


def likelihood_table(spark: SparkSession, sigmas=lk.SIGMAS) -> DataFrame:
    """``(sigma, k, q)``: one row per sigma and count, ``q`` over the rate grid."""
    base = spark.createDataFrame([(int(s),) for s in sigmas], "sigma int").repartition(len(sigmas), "sigma")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch["sigma"]:
                table = lk.count_table(int(s))
                yield pd.DataFrame({"sigma": s, "k": range(len(table)), "q": list(table)})

    return base.mapInPandas(build, "sigma int, k int, q array<double>")


# ---- likelihood over tables --------------------------------------------------------------------

def log_likelihood_terms(entries: DataFrame, sigma: int, x: str, y: str) -> DataFrame:
    """Add ``q``, ``nll`` and the derivatives ``d1, d2`` to rows holding a rate and a count."""
    spark = entries.sparkSession
    shared = spark.sparkContext.broadcast((lk.count_table(sigma), lk.rate_grid()))

    @F.pandas_udf("q double, nll double, d1 double, d2 double")
    def terms(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        table, grid = shared.value
        q = lk.probability(xs.to_numpy(), ys.to_numpy(), table, grid)
        d1, d2 = lk.log_derivatives(xs.to_numpy(), ys.to_numpy(), table, grid)
        return pd.DataFrame({"q": q, "nll": -np.log(q), "d1": d1, "d2": d2})

    return entries.withColumn("_t", terms(F.col(x).cast("double"), F.col(y).cast("double"))).select(
        *entries.columns, "_t.*")


# ---- fits ------------------------------------------------------------------------------------

def fit_bulk(design: DataFrame, total_umi: float, n_iter: int = 100, tol: float = 1e-4) -> DataFrame:
    """One fit of the gene totals: ``(cell_type, weight)``. Input rows are genes x types."""
    spark = design.sparkSession
    rows = design.toPandas().pivot_table(index=["gene", "b"], columns="cell_type", values="x", fill_value=0.0)
    b = rows.index.get_level_values("b").to_numpy(float)
    # The design holds the totals already, so its size only sets the floor of predictions.
    w, _, _ = fit_stack(rows.to_numpy(float) / total_umi, np.array([total_umi]), b[None], None, None, n_iter, tol)
    return spark.createDataFrame([(str(t), float(v)) for t, v in zip(rows.columns, w[0])], "cell_type string, weight double")


def fit_spots(
    spots: DataFrame, profiles: Profiles, sigma: int, n_iter: int = 50, tol: float = 1e-3, constrain: bool = False,
) -> DataFrame:
    """``(id, n_umi, weights, n_iter, converged)``; weights follow ``profiles.types`` and need not sum to 1."""
    spark = spots.sparkSession
    shared = spark.sparkContext.broadcast((profiles.matrix, lk.count_table(sigma), lk.rate_grid()))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, table, grid = shared.value
        for batch in batches:
            for lo in range(0, len(batch), STACK):
                part = batch.iloc[lo:lo + STACK]
                y = np.minimum(np.stack(part["v"].to_numpy()), lk.MAX_COUNT)
                w, n, ok = fit_stack(matrix, part["n_umi"].to_numpy(float), y, table, grid, n_iter, tol, constrain)
                yield pd.DataFrame({"id": part["id"], "n_umi": part["n_umi"], "weights": list(w), "n_iter": n, "converged": ok})

    key = f"id {spots.schema['id'].dataType.simpleString()}"
    return spread(spots, "id", rows=64).mapInPandas(fit, f"{key}, n_umi double, weights array<double>, n_iter int, converged boolean")


def long_weights(fitted: DataFrame, types: list[str]) -> DataFrame:
    names = F.array(*[F.lit(t) for t in types])
    return fitted.select("id", F.posexplode("weights").alias("ix", "weight")).select(
        "id", F.element_at(names, F.col("ix") + 1).alias("cell_type"), "weight")


def sigma_window(sigma: int) -> np.ndarray:
    at = int(np.flatnonzero(lk.SIGMAS == round(sigma))[0])
    return lk.SIGMAS[max(0, at - SIGMA_WINDOW):at + SIGMA_WINDOW + 1]


def sample_entries(entries: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
    """Likelihood entries of the sigma fit: all of them, or ``n`` where a bound is asked for."""
    if n is None:
        return entries
    key = F.concat_ws("-", F.col("id").cast("string"), F.col("ix").cast("string"))
    return entries.orderBy(hash_order(key, seed), "id", "ix").limit(n)


def score_sigmas(entries: DataFrame, sigmas) -> DataFrame:
    """``(sigma, score)``: negative log-likelihood at the best of five rate multipliers."""
    return _scores(entries, _shared_tables(entries, sigmas))


def refit_sigma(entries: DataFrame, sigma: int) -> int:
    """The best of the window around ``sigma``; the window's tables, 35 MB, leave the driver and the executors again."""
    shared = _shared_tables(entries, sigma_window(sigma))
    try:
        return best_sigma(_scores(entries, shared))
    finally:
        shared.destroy()


def _shared_tables(entries: DataFrame, sigmas) -> Broadcast:
    packed = {int(s): lk.count_table(int(s)) for s in sigmas}
    return entries.sparkSession.sparkContext.broadcast((packed, lk.rate_grid()))


def _scores(entries: DataFrame, shared: Broadcast) -> DataFrame:
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed, grid = shared.value
        for batch in batches:
            x, k = np.maximum(batch["x"].to_numpy(), 1e-4), np.minimum(batch["y"].to_numpy(), lk.MAX_COUNT).astype(int)
            rows = []
            for m in MULTIPLIERS:
                # A rate's place on the grid is the same for every sigma.
                low, share = lk.locate(x * m, grid)
                rows += [(s, m, float(-np.log(lk.interpolate(table, k, low, share)).sum())) for s, table in packed.items()]
            yield pd.DataFrame(rows, columns=["sigma", "mult", "nll"])

    pairs = entries.select(F.col("x").cast("double"), F.col("y").cast("double"))
    part = spread(pairs, rows=20_000).mapInPandas(
        score, "sigma int, mult double, nll double")
    return part.groupBy("sigma", "mult").agg(F.sum("nll").alias("nll")).groupBy("sigma").agg(
        F.min("nll").alias("score"))


def best_sigma(scores: DataFrame) -> int:
    return scores.agg(F.min_by("sigma", F.struct(F.round("score", 6), F.col("sigma")))).first()[0]


def expected_counts(fitted: DataFrame, spots: DataFrame, profiles: Profiles) -> DataFrame:
    """``(id, ix, x, y)``: expected and observed count per spot and gene."""
    shared = spots.sparkSession.sparkContext.broadcast(profiles.matrix)

    @F.pandas_udf("array<double>")
    def predict(w: pd.Series, size: pd.Series) -> pd.Series:
        m = np.stack(w.to_numpy()) @ shared.value.T * size.to_numpy()[:, None]
        return pd.Series(list(m))

    both = fitted.select("id", predict("weights", "n_umi").alias("p")).join(spots.select("id", "v"), "id")
    return both.select("id", F.posexplode(F.arrays_zip("p", "v")).alias("ix", "e")).select(
        "id", "ix", F.col("e.p").alias("x"), F.col("e.v").alias("y"))


def choose_sigma(
    spots: DataFrame, profiles: Profiles, min_umi: float = 100, n_fit: int | None = None,
    n_entries: int | None = None, epochs: int = SIGMA_EPOCHS, seed: int = 0, start: int = START_SIGMA,
) -> int:
    """Alternate spot fits and a local sigma search; ``n_fit`` spots and ``n_entries`` entries bound them on request."""
    sample = spots.where(F.col("n_umi") > min_umi)
    if n_fit is not None:
        sample = sample.orderBy(hash_order(F.col("id"), seed), "id").limit(n_fit)
    sample = materialize(sample, "sigma-spots")
    if sample.limit(1).count() == 0:
        raise ValueError("no spot exceeds min_umi; lower it")
    sigma = start
    for _ in range(epochs):
        fitted = fit_spots(sample, profiles, sigma)
        entries = materialize(sample_entries(expected_counts(fitted, sample, profiles), n_entries, seed), "entries")
        previous, sigma = sigma, best_sigma(score_sigmas(entries, sigma_window(sigma)))
        if sigma == previous:
            break
    return sigma


def decompose(
    counts: DataFrame, sizes: DataFrame, profiles: DataFrame, genes: DataFrame, min_umi: float = 100,
    sigma: int | None = None, mode: str = "full",
) -> tuple[DataFrame, Profiles, int]:
    """Weights of every spot: sigma first, then all spots."""
    if mode != "full":
        raise ValueError("only the full mode is defined")
    axis = gene_axis(genes)
    spots = materialize(spot_rows(counts, sizes, axis), "spots")
    shapes = Profiles(profiles, axis)
    sigma = choose_sigma(spots, shapes, min_umi) if sigma is None else sigma
    return fit_spots(spots, shapes, sigma), shapes, sigma
