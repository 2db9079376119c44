"""Graph attention classifier trained on blocks of a spatial graph.

Nodes are grouped into spatial blocks of bounded size. A block carries its own nodes, their
neighbours and the neighbours' neighbours, so a two-layer network is exact inside the block and
an epoch is one map job over blocks. The graph is directed: a node attends to its listed
neighbours and itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tissuegrid.operators.training import Adam, keyed_uniform, pack, summed, unpack
from tissuegrid.session import materialize, spread

SLOPE = 0.2
MAX_DEGREE = 10_000


@dataclass
class GatConfig:
    hidden: int = 128
    heads: int = 2
    dropout: float = 0.2
    lr: float = 0.01
    epochs: int = 100
    seed: int = 20230825
    block_nodes: int = 1024


def new_params(n_features: int, n_classes: int, c: GatConfig) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(c.seed)

    def glorot(*shape):
        bound = np.sqrt(6 / (shape[-2] + shape[-1]))
        return rng.uniform(-bound, bound, shape)

    wide = c.heads * c.hidden
    return {
        "w1": glorot(n_features, wide), "s1": glorot(c.heads, c.hidden), "d1": glorot(c.heads, c.hidden), "b1": np.zeros(wide),
        "w2": glorot(wide, n_classes), "s2": glorot(1, n_classes), "d2": glorot(1, n_classes), "b2": np.zeros(n_classes),
    }


# ---- one attention layer -------------------------------------------------------------------------

def attend(x, src, dst, n_out, w, a_src, a_dst, bias):
    """Heads of size ``a.shape[1]``; node ``dst`` gathers from ``src``. Returns output and trace."""
    heads, size = a_src.shape
    h = (x @ w).reshape(len(x), heads, size)
    raw = (h * a_src).sum(-1)[src] + (h * a_dst).sum(-1)[dst]
    score = np.where(raw > 0, raw, SLOPE * raw)
    top = np.full((n_out, heads), -np.inf)
    np.maximum.at(top, dst, score)
    e = np.exp(score - top[dst])
    z = np.zeros((n_out, heads))
    np.add.at(z, dst, e)
    alpha = e / z[dst]
    out = np.zeros((n_out, heads, size))
    np.add.at(out, dst, alpha[..., None] * h[src])
    return out.reshape(n_out, heads * size) + bias, (x, src, dst, h, raw, alpha)


def attend_back(d_out, trace, w, a_src, a_dst):
    x, src, dst, h, raw, alpha = trace
    heads, size = a_src.shape
    d = d_out.reshape(len(d_out), heads, size)
    d_alpha = (d[dst] * h[src]).sum(-1)
    d_h = np.zeros_like(h)
    np.add.at(d_h, src, alpha[..., None] * d[dst])
    mean = np.zeros((len(d_out), heads))
    np.add.at(mean, dst, alpha * d_alpha)
    d_raw = alpha * (d_alpha - mean[dst]) * np.where(raw > 0, 1.0, SLOPE)
    to_src, to_dst = np.zeros(h.shape[:2]), np.zeros(h.shape[:2])
    np.add.at(to_src, src, d_raw)
    np.add.at(to_dst, dst, d_raw)
    d_h += to_src[..., None] * a_src + to_dst[..., None] * a_dst
    flat = d_h.reshape(len(x), -1)
    return (flat @ w.T, x.T @ flat, (to_src[..., None] * h).sum(0), (to_dst[..., None] * h).sum(0), d_out.sum(0))


def network(block, p, mask=None):
    """Logits of the block's own nodes. Nodes are ordered own, first ring, second ring."""
    x, n_own, n_mid = block["x"], block["n_own"], block["n_mid"]
    h, t1 = attend(x, block["src1"], block["dst1"], n_mid, p["w1"], p["s1"], p["d1"], p["b1"])
    live = np.maximum(h, 0) if mask is None else np.maximum(h, 0) * mask
    out, t2 = attend(live, block["src2"], block["dst2"], n_own, p["w2"], p["s2"], p["d2"], p["b2"])
    return out, (h, t1, t2)


def block_gradient(block, p, mask):
    """Cross-entropy sum over labelled own nodes and its gradient."""
    out, (h, t1, t2) = network(block, p, mask)
    soft = np.exp(out - out.max(1, keepdims=True))
    soft /= soft.sum(1, keepdims=True)
    known = block["label"] >= 0
    rows = np.flatnonzero(known)
    d = np.where(known[:, None], soft, 0.0)
    d[rows, block["label"][rows]] -= 1
    loss = -np.log(np.maximum(soft[rows, block["label"][rows]], 1e-300)).sum()
    g = {}
    d, g["w2"], g["s2"], g["d2"], g["b2"] = attend_back(d, t2, p["w2"], p["s2"], p["d2"])
    d = d * (h > 0) * (1.0 if mask is None else mask)
    _, g["w1"], g["s1"], g["d1"], g["b1"] = attend_back(d, t1, p["w1"], p["s1"], p["d1"])
    return loss, len(rows), g


# ---- blocks ------------------------------------------------------------------------------------

def spatial_order(x: Column, y: Column, box: Column, bits: int = 16) -> Column:
    """Position on a Z-curve over the bounding box ``struct<x0, x1, y0, y1>``."""
    top = F.lit(2 ** bits - 1)

    def level(v, lo, hi):
        return F.floor(F.coalesce(F.try_divide(v - lo, hi - lo), F.lit(0.0)) * top).cast("long")

    qx, qy = level(x, box["x0"], box["x1"]), level(y, box["y0"], box["y1"])
    terms = [F.shiftleft(F.shiftright(q, i).bitwiseAND(1), 2 * i + s) for i in range(bits) for s, q in ((0, qx), (1, qy))]
    return sum(terms[1:], terms[0])


def with_order(nodes: DataFrame) -> DataFrame:
    """Add ``order`` from coordinates ``x, y``."""
    box = nodes.agg(F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"),
                             F.min("y").alias("y0"), F.max("y").alias("y1"))).scalar()
    return nodes.withColumn("_box", box).withColumn(
        "order", spatial_order(F.col("x"), F.col("y"), F.col("_box"))).drop("_box")


def graph_blocks(nodes: DataFrame, edges: DataFrame, block_nodes: int) -> DataFrame:
    """``nodes(id, order, v, label)`` and ``edges(src, dst)`` -> one packed row per block.

    ``src`` attends to ``dst``. ``label`` NULL means unlabelled. Nodes are range-partitioned by
    ``order`` (a spatial sort key), so neighbours tend to share a block.
    """
    worst = edges.groupBy("src").count().agg(F.max("count")).first()[0] or 0
    if worst > MAX_DEGREE:
        raise ValueError(f"a node attends to {worst} others; thin the graph first")
    from tissuegrid.operators.ranking import row_numbers

    ranked = row_numbers(nodes.select("id", "order"), [F.col("order"), F.col("id")], "_rn")
    home = materialize(ranked.select("id", F.floor((F.col("_rn") - 1) / block_nodes).alias("block")), "home")
    e = edges.select("src", "dst").distinct()
    own = home.select("block", F.col("id").alias("node"), F.lit(0).alias("ring"))
    first = own.join(e, F.col("node") == F.col("src")).select("block", F.col("dst").alias("node"), F.lit(1).alias("ring"))
    near = materialize(own.unionByName(first).groupBy("block", "node").agg(F.min("ring").alias("ring")), "near")
    second = near.join(e, F.col("node") == F.col("src")).select("block", F.col("dst").alias("node"), F.lit(2).alias("ring"))
    members = near.unionByName(second).groupBy("block", "node").agg(F.min("ring").alias("ring"))
    rows = members.join(nodes.select(F.col("id").alias("node"), "v", F.coalesce("label", F.lit(-1)).cast("int").alias("label"),
                                     F.xxhash64("id").alias("key")), "node")
    links = near.join(e, F.col("node") == F.col("src")).select(F.col("block").alias("at"), "src", "dst")
    id_type = nodes.schema["id"].dataType.simpleString()

    def packed(key: tuple[Any, ...], members: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        m = members.sort_values(["ring", "node"]).reset_index(drop=True)
        at = pd.Series(np.arange(len(m)), index=m["node"])
        n_own, n_mid = int((m["ring"] == 0).sum()), int((m["ring"] <= 1).sum())
        dst = np.concatenate([at[links["src"]].to_numpy(int), np.arange(n_mid)])
        src = np.concatenate([at[links["dst"]].to_numpy(int), np.arange(n_mid)])
        order = np.lexsort((src, dst))
        x = np.stack(m["v"].to_numpy()).astype(float)
        return pd.DataFrame({
            "block": [key[0]], "ids": [m["node"][:n_own].tolist()], "label": [m["label"][:n_own].tolist()],
            "n_mid": [n_mid], "keys": [m["key"][:n_mid].to_numpy(np.int64).tobytes()], "width": [x.shape[1]], "x": [x.tobytes()],
            "src": [src[order].astype(np.int64).tobytes()], "dst": [dst[order].astype(np.int64).tobytes()]})

    out = rows.groupBy("block").cogroup(links.groupBy("at")).applyInPandas(
        packed, f"block long, ids array<{id_type}>, label array<int>, n_mid int, keys binary, width int, x binary, src binary, dst binary")
    return materialize(out, "blocks")


def _open(row) -> dict:
    src, dst = np.frombuffer(row.src, np.int64), np.frombuffer(row.dst, np.int64)
    n_own = len(row.ids)
    top = dst < n_own
    return {"x": np.frombuffer(row.x).reshape(-1, row.width), "n_own": n_own, "n_mid": row.n_mid, "src1": src, "dst1": dst,
            "src2": src[top], "dst2": dst[top], "label": np.asarray(row.label, int),
            "keys": np.frombuffer(row.keys, np.int64).view(np.uint64)}


def train(blocks: DataFrame, n_classes: int, config: GatConfig | None = None) -> tuple[dict[str, np.ndarray], list[float]]:
    c = config or GatConfig()
    spark = blocks.sparkSession
    p = new_params(blocks.first()["width"], n_classes, c)
    opt, losses = Adam(c.lr, pack(p).size), []
    blocks = materialize(spread(blocks, "block", at_most=blocks.count()), "blocks")
    for epoch in range(c.epochs):
        shared = spark.sparkContext.broadcast(p)

        def gradient(batch: pd.DataFrame, shared=shared, epoch=epoch) -> np.ndarray:
            total = 0.0
            for row in batch.itertuples():
                b = _open(row)
                # A node is dropped or kept alike in every block that holds it.
                keep = keyed_uniform(b["keys"], c.heads * c.hidden, c.seed + epoch) >= c.dropout
                loss, n, g = block_gradient(b, shared.value, keep / (1 - c.dropout))
                total = total + np.concatenate([[loss, n], pack(g)])
            return total

        got = summed(blocks, gradient)
        if got[1] == 0:
            raise ValueError("no labelled node")
        p = unpack(opt.step(pack(p), got[2:] / got[1]), p)
        losses.append(got[0] / got[1])
        shared.unpersist()
    return p, losses


def predict(blocks: DataFrame, params: dict[str, np.ndarray]) -> DataFrame:
    """``(id, label, score)`` of every node; ties take the lowest label."""
    shared = blocks.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                out, _ = network(_open(row), shared.value)
                yield pd.DataFrame({"id": list(row.ids), "label": out.argmax(1), "score": out.max(1)})

    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    return blocks.mapInPandas(run, f"id {id_type}, label long, score double")


def fill_labels(
    nodes: DataFrame, edges: DataFrame, n_classes: int, config: GatConfig | None = None, params: dict[str, np.ndarray] | None = None,
):
    """Train on the labelled nodes, unless trained ``params`` are given, and label the rest; known labels stay."""
    c = config or GatConfig()
    blocks = graph_blocks(nodes, edges, c.block_nodes)
    params, losses = (params, []) if params is not None else train(blocks, n_classes, c)
    found = predict(blocks, params).withColumnRenamed("label", "_new")
    return nodes.select("id", "label").join(found, "id").select(
        "id", F.coalesce(F.col("label").cast("long"), F.col("_new")).alias("label")), params, losses
