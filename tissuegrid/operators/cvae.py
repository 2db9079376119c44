"""Conditional variational autoencoder that moves spot profiles to the reference platform.

Training rows are pseudo-mixtures and real rows of both domains. A step is one job. Batch normalisation
takes its statistics over groups of rows chosen by their keys, or over the whole batch in a barrier
stage; neither depends on how the rows are laid out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuegrid.operators.impute import dense_vectors
from tissuegrid.operators.normalize import min_max_fit
from tissuegrid.operators.sampling import random_mix
from tissuegrid.operators.training import (
    Adam,
    Gather,
    alone,
    batch_moments,
    keyed_normal,
    pack,
    summed_groups,
    summed_together,
    unpack,
)
from tissuegrid.session import materialize, release

BN_EPS = 1e-5
BN_MOMENTUM = 0.1
WHOLE_BATCH_TASK_ROWS = 256
# A batch is made of this many stored slices of the rows, drawn anew in every epoch.
BATCH_SLICES = 8
# Bytes of rows that a task packs into blocks.
BLOCK_TASK_BYTES = 32 << 20


@dataclass
class CvaeConfig:
    """Fixed defaults of the adaptation step.

    ``norm_rows`` is the mean size of the groups that batch normalisation works on; None takes the whole
    batch, whose tasks then exchange some 14 vectors a step, each taking about a second.
    """

    lr: float = 0.01
    batch: int = 16384
    epochs: int = 200
    samples: int = 50_000
    sc_mix: tuple[int, int] = (2, 8)
    st_mix: tuple[int, int] = (2, 6)
    top: float = 10.0
    hidden_layers: int = 2
    beta: float = 1.0
    seed: int = 30
    log: bool = True
    norm_rows: int | None = 1024


@dataclass
class Cvae:
    config: CvaeConfig
    genes: int
    latent: int
    params: dict[str, np.ndarray] = field(default_factory=dict)
    running: dict[str, np.ndarray] = field(default_factory=dict)
    scale_sc: tuple[np.ndarray, np.ndarray] | None = None
    scale_st: tuple[np.ndarray, np.ndarray] | None = None
    losses: list[float] = field(default_factory=list)


def hidden_sizes(latent: int, genes: int, layers: int) -> list[int]:
    return [int(x) for x in np.floor(np.geomspace(latent, genes, layers + 2)[1:layers + 1])]


def new_model(genes: int, n_types: int, config: CvaeConfig) -> Cvae:
    latent = 3 * n_types
    up = hidden_sizes(latent, genes, config.hidden_layers)
    rng = np.random.default_rng(config.seed)
    model = Cvae(config, genes, latent)

    def layer(name: str, n_in: int, n_out: int) -> None:
        bound = 1 / np.sqrt(n_in)
        model.params[f"{name}.w"] = rng.uniform(-bound, bound, (n_in, n_out))
        model.params[f"{name}.g"], model.params[f"{name}.b"] = np.ones(n_out), np.zeros(n_out)
        model.running[f"{name}.m"], model.running[f"{name}.v"] = np.zeros(n_out), np.ones(n_out)

    n = genes + 1
    for i, h in enumerate(reversed(up)):
        layer(f"enc{i}", n, h)
        n = h
    layer("mean", n, latent)
    layer("logvar", n, latent)
    n = latent + 1
    for i, h in enumerate(up):
        layer(f"dec{i}", n, h)
        n = h
    layer("out", n, genes)
    return model


def _forward(x, name, params, stats, act, trace=None, gather=alone):
    """Linear, batch norm, activation. ``stats`` None uses the batch and records it in ``trace``."""
    a = x @ params[f"{name}.w"]
    rows, mean, var = batch_moments(a, gather) if stats is None else (0, stats[f"{name}.m"], stats[f"{name}.v"])
    inv = 1 / np.sqrt(var + BN_EPS)
    z = (a - mean) * inv
    y = z * params[f"{name}.g"] + params[f"{name}.b"]
    out = {"elu": np.where(y > 0, y, np.expm1(np.minimum(y, 0))), "relu": np.maximum(y, 0), "none": y}[act]
    if trace is not None:
        trace[name] = (x, z, inv, y, act, mean, var, rows)
    return out


def _backward(d, name, params, trace, grads, gather=alone):
    """Gradient at the input; parameters get the share of the rows at hand."""
    x, z, inv, y, act, _, _, rows = trace[name]
    if act == "elu":
        d = d * np.where(y > 0, 1.0, np.exp(np.minimum(y, 0)))
    elif act == "relu":
        d = d * (y > 0)
    grads[f"{name}.g"], grads[f"{name}.b"] = (d * z).sum(0), d.sum(0)
    along, level = gather(np.concatenate([grads[f"{name}.g"], grads[f"{name}.b"]])).sum(0).reshape(2, -1) / rows
    d = inv * params[f"{name}.g"] * (d - level - z * along)
    grads[f"{name}.w"] = x.T @ d
    return d @ params[f"{name}.w"].T


def _encode(x, cond, params, layers, stats, trace=None, gather=alone):
    h = np.hstack([x, cond])
    for i in range(layers):
        h = _forward(h, f"enc{i}", params, stats, "elu", trace, gather)
    return tuple(_forward(h, name, params, stats, "none", trace, gather) for name in ("mean", "logvar"))


def _decode(z, cond, params, layers, stats, trace=None, gather=alone):
    h = np.hstack([z, cond])
    for i in range(layers):
        h = _forward(h, f"dec{i}", params, stats, "elu", trace, gather)
    return _forward(h, "out", params, stats, "relu", trace, gather)


def loss_and_gradient(x, cond, weight, eps, params, layers, beta, gather: Gather = alone):
    """Weighted squared error plus ``beta`` x KL, its gradient, and the statistics of the batch.

    Loss and gradient are the share of these rows in a batch that the tasks behind ``gather`` hold together.
    """
    trace, grads = {}, {}
    mu, logvar = _encode(x, cond, params, layers, None, trace, gather)
    std = np.exp(0.5 * logvar)
    out = _decode(mu + eps * std, cond, params, layers, None, trace, gather)
    w = weight[:, None]
    loss = (w * (out - x) ** 2).sum() - 0.5 * beta * (w * (1 + logvar - mu ** 2 - np.exp(logvar))).sum()
    d = _backward(2 * w * (out - x), "out", params, trace, grads, gather)
    for i in reversed(range(layers)):
        d = _backward(d, f"dec{i}", params, trace, grads, gather)
    d = d[:, :-1]
    d_mu = d + beta * w * mu
    d_logvar = d * eps * 0.5 * std - 0.5 * beta * w * (1 - np.exp(logvar))
    d = _backward(d_mu, "mean", params, trace, grads, gather) + _backward(d_logvar, "logvar", params, trace, grads, gather)
    for i in reversed(range(layers)):
        d = _backward(d, f"enc{i}", params, trace, grads, gather)
    stats = {f"{n}.{s}": t[5 + j] for n, t in trace.items() for j, s in enumerate("mv")}
    return loss, grads, stats


# ---- training rows -----------------------------------------------------------------------------

def _domain_weights(n_pseudo: int, n_real: int) -> tuple[float, float]:
    if n_pseudo > n_real:
        return n_real / n_pseudo, 1.0
    return 1.0, (n_pseudo / n_real if 0 < n_pseudo < n_real else 1.0)


def training_rows(st: DataFrame, sc: DataFrame, axis: DataFrame, n_types: int, config: CvaeConfig):
    """``(key, v, cond, weight)`` of pseudo and real rows of both domains, plus the two scalers.

    ``st`` and ``sc`` are long counts on a common scale; rows stay on that scale and the scaling
    to 0..top happens in the tasks.
    """
    spark = st.sparkSession
    st, sc = materialize(st, "st"), materialize(sc, "sc")
    n_st, n_sc = (d.select("id").distinct().count() for d in (st, sc))
    n_mix_sc = int(min(100 * n_st * n_types, config.samples))
    n_mix_st = n_mix_sc // 2
    mixes = {
        "st": random_mix(st, spark.range(n_mix_st).withColumnRenamed("id", "mix_id"), config.st_mix[1], config.st_mix[0], config.seed),
        "sc": random_mix(sc, spark.range(n_mix_sc).withColumnRenamed("id", "mix_id"), config.sc_mix[1], config.sc_mix[0], config.seed + 9),
    }
    w_st, w_sc = _domain_weights(n_mix_st, n_st), _domain_weights(n_mix_sc, n_sc)
    sum_st, sum_sc = w_st[0] * n_mix_st + w_st[1] * n_st, w_sc[0] * n_mix_sc + w_sc[1] * n_sc
    f_st, f_sc = (sum_sc / sum_st, 1.0) if sum_sc < sum_st else (1.0, sum_st / sum_sc)
    parts, scales = [], []
    for tag, real, cond, w, f, n in (("st", st, config.top, w_st, f_st, n_st), ("sc", sc, 0.0, w_sc, f_sc, n_sc)):
        for kind, rows, weight in (("mix", mixes[tag].withColumnRenamed("mix_id", "id"), w[0]), ("real", real, w[1])):
            parts.append(dense_vectors(rows, axis).select(
                F.xxhash64(F.lit(f"{tag}-{kind}"), "id").alias("key"), "v", F.lit(cond).alias("cond"),
                F.lit(float(weight * f)).alias("weight")))
        level = real.withColumn("value", F.log1p("value")) if config.log else real
        scales.append(_scale(min_max_fit(level.withColumnRenamed("gene", "feature"), n_rows=F.lit(n)), axis))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return materialize(rows, "training"), scales[0], scales[1]


def _scale(fit: DataFrame, axis: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Lower end and width per gene as arrays: bounded by the gene axis."""
    rows = axis.join(fit.withColumnRenamed("feature", "gene"), "gene", "left").orderBy("ix").toPandas().fillna(0.0)
    lo, hi = rows["lo"].to_numpy(float), rows["hi"].to_numpy(float)
    return lo, np.where(hi > lo, hi - lo, 1.0)


def scaled(v: np.ndarray, scale, top: float, log: bool) -> np.ndarray:
    return ((np.log1p(v) if log else v) - scale[0]) / scale[1] * top


def vector_scale(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Lower end and width per position of dense vectors."""
    rows = vectors.select(F.posexplode("v").alias("ix", "value")).groupBy("ix").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("ix").toPandas()
    lo, hi = rows["lo"].to_numpy(float), rows["hi"].to_numpy(float)
    return lo, np.where(hi > lo, hi - lo, 1.0)


# ---- training and use ----------------------------------------------------------------------------

def _blocks(rows: DataFrame, genes: int) -> DataFrame:
    """Rows of one ``slice`` and ``group`` packed into one row, or a few: their ``keys`` and ``numbers`` (v, cond, weight).

    A step then moves few packed rows instead of many lists.
    """
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            numbers = np.column_stack([
                np.array(batch["v"].tolist(), dtype=float).reshape(-1, genes), batch["cond"].to_numpy(dtype=float),
                batch["weight"].to_numpy(dtype=float)])
            keys, of, group = (batch[n].to_numpy(dtype=np.int64) for n in ("key", "slice", "group"))
            order = np.lexsort((group, of))
            keys, numbers, of, group = keys[order], numbers[order], of[order], group[order]
            first = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(group) != 0)])
            ends = np.r_[first[1:], len(keys)]
            yield pd.DataFrame({
                "slice": of[first], "group": group[first], "keys": [keys[a:b].tobytes() for a, b in zip(first, ends)],
                "numbers": [numbers[a:b].tobytes() for a, b in zip(first, ends)]})

    n = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() * (genes + 3) * 8 // BLOCK_TASK_BYTES)
    laid = rows.select("key", "v", "cond", "weight", "slice", "group").repartition(n, "slice").sortWithinPartitions("slice", "group")
    return materialize(laid.mapInPandas(packed, "slice int, group int, keys binary, numbers binary"), "blocks", by="slice")


def _unpacked(blocks: pd.DataFrame, genes: int) -> tuple[np.ndarray, ...]:
    """``key``, ``v``, ``cond`` and ``weight`` of the rows in ``blocks``, in the order of their keys."""
    keys = np.frombuffer(b"".join(blocks["keys"]), dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    numbers = np.frombuffer(b"".join(blocks["numbers"])).reshape(-1, genes + 2)[order]
    return keys[order], numbers[:, :genes], numbers[:, genes], numbers[:, genes + 1]


def train(rows: DataFrame, model: Cvae, tasks: int | None = None) -> Cvae:
    """Fit ``model``. The result depends on the keys of the rows, not on ``tasks`` or the layout of ``rows``."""
    c = model.config
    spark = rows.sparkSession
    n_rows = rows.count()
    n_steps = max(1, -(-n_rows // c.batch))
    n_groups = max(1, n_rows // ((c.norm_rows or WHOLE_BATCH_TASK_ROWS) * n_steps))
    if tasks is None:
        tasks = min(spark.sparkContext.defaultParallelism, n_groups)
    n_slices = n_steps * BATCH_SLICES
    drawn = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n)).cast("int")
    sliced = rows.withColumn("slice", drawn(n_slices, c.seed)).withColumn("group", drawn(n_groups, c.seed + 1))
    if c.norm_rows is not None:
        base = _blocks(sliced, model.genes)
    else:
        base = materialize(sliced.repartition("slice"), "slices", by="slice") if n_steps > 1 else rows
    n_params = pack(model.params).size
    size = 2 + n_params + pack(model.running).size
    opt = Adam(c.lr, n_params)
    for epoch in range(c.epochs):
        total = 0.0
        order = np.random.default_rng([c.seed, epoch]).permutation(n_slices)
        for step in range(n_steps):
            shared = spark.sparkContext.broadcast((model.params, model.scale_st, model.scale_sc))
            clock = c.seed * 100_003 + epoch * n_steps + step
            genes, latent = model.genes, model.latent

            def share(key, v, cond, weight, gather: Gather = alone, shared=shared, clock=clock) -> np.ndarray:
                params, scale_st, scale_sc = shared.value
                x = np.where(cond[:, None] > 0, scaled(v, scale_st, c.top, c.log), scaled(v, scale_sc, c.top, c.log))
                eps = keyed_normal(key.view(np.uint64), latent, clock)
                loss, grads, stats = loss_and_gradient(x, cond[:, None], weight, eps, params, c.hidden_layers, c.beta, gather)
                return np.concatenate([[loss, len(x)], pack(grads), pack(stats) * len(x)])

            def of_rows(batch: pd.DataFrame, gather: Gather, share=share) -> np.ndarray:
                return share(batch["key"].to_numpy(dtype=np.int64), np.array(batch["v"].tolist(), dtype=float).reshape(-1, genes),
                             batch["cond"].to_numpy(dtype=float), batch["weight"].to_numpy(dtype=float), gather)

            part = base
            if n_steps > 1:
                chosen = order[step * BATCH_SLICES:(step + 1) * BATCH_SLICES]
                part = base.where(F.col("slice").isin([int(i) for i in chosen]))
            if c.norm_rows is None:
                got = summed_together(part, tasks, "key", of_rows)
            else:
                got = summed_groups(part.select("group", "keys", "numbers"), tasks, "group", size,
                                    lambda blocks, share=share: share(*_unpacked(blocks, genes)))
            model.params = unpack(opt.step(pack(model.params), got[2:2 + n_params]), model.params)
            seen = unpack(got[2 + n_params:] / got[1], model.running)
            model.running = {k: (1 - BN_MOMENTUM) * v + BN_MOMENTUM * seen[k] for k, v in model.running.items()}
            total += float(got[0])
            shared.unpersist()
        model.losses.append(total / n_steps)
    if base is not rows:
        release(base)
    return model


def reconstruct(vectors: DataFrame, model: Cvae, domain: str) -> DataFrame:
    """``(id, v)`` on the common scale: encode under the own condition, decode as reference."""
    c = model.config
    shared = vectors.sparkSession.sparkContext.broadcast((model.params, model.running, model.scale_st, model.scale_sc))
    cond_in = c.top if domain == "st" else 0.0

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        params, stats, scale_st, scale_sc = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = scaled(np.stack(batch["v"].to_numpy()), scale_st if domain == "st" else scale_sc, c.top, c.log)
            cond = np.full((len(x), 1), cond_in)
            mu, logvar = _encode(x, cond, params, c.hidden_layers, stats)
            eps = keyed_normal(batch["key"].to_numpy().view(np.uint64), model.latent, c.seed)
            out = _decode(mu + eps * np.exp(0.5 * logvar), np.zeros_like(cond), params, c.hidden_layers, stats)
            out = out / c.top * scale_sc[1] + scale_sc[0]
            out = np.expm1(out) if c.log else out
            yield pd.DataFrame({"id": batch["id"], "v": list(np.nan_to_num(out, nan=0.0, posinf=0.0, neginf=0.0))})

    keyed = vectors.select("id", "v", F.xxhash64("id").alias("key"))
    return keyed.mapInPandas(rebuild, f"id {vectors.schema['id'].dataType.simpleString()}, v array<double>")


def adapt_domains(st: DataFrame, sc: DataFrame, axis: DataFrame, n_types: int, config: CvaeConfig | None = None):
    """Train on both domains; returns the model and both reconstructions."""
    config = config or CvaeConfig()
    rows, scale_st, scale_sc = training_rows(st, sc, axis, n_types, config)
    model = new_model(axis.count(), n_types, config)
    model.scale_st, model.scale_sc = scale_st, scale_sc
    train(rows, model)
    return (model, reconstruct(dense_vectors(st, axis), model, "st"),
            reconstruct(dense_vectors(sc, axis), model, "sc"))


# ---- storage -----------------------------------------------------------------------------------

def save_model(spark, model: Cvae, path: str) -> None:
    scales = {"scale.st.lo": model.scale_st[0], "scale.st.w": model.scale_st[1],
              "scale.sc.lo": model.scale_sc[0], "scale.sc.w": model.scale_sc[1]}
    every = {**{f"p.{k}": v for k, v in model.params.items()}, **{f"r.{k}": v for k, v in model.running.items()}, **scales}
    rows = [(k, list(v.shape), v.ravel().tolist()) for k, v in every.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, value array<double>").write.mode("overwrite").parquet(path)


def load_model(spark, path: str, genes: int, n_types: int, config: CvaeConfig | None = None) -> Cvae:
    model = new_model(genes, n_types, config or CvaeConfig())
    for row in spark.read.parquet(path).collect():
        value = np.array(row["value"]).reshape(row["shape"])
        kind, name = row["name"].split(".", 1)
        if kind == "p":
            model.params[name] = value
        elif kind == "r":
            model.running[name] = value
    got = {r["name"]: np.array(r["value"]) for r in spark.read.parquet(path).where("name LIKE 'scale.%'").collect()}
    model.scale_st, model.scale_sc = (got["scale.st.lo"], got["scale.st.w"]), (got["scale.sc.lo"], got["scale.sc.w"])
    return model
