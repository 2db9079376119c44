"""Data-parallel training: tasks return gradient sums of their rows, the driver updates parameters.

Parameters are bounded by the model, not by the data. Partial sums are merged in two stages, so
the driver receives a fixed number of vectors. Where a step needs statistics of several rows, they are
those of keyed groups of rows, or of the whole batch, whose tasks then exchange them in a barrier stage.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Widths of the merge stages; the wide one only pays on clusters with many tasks.
WIDE_MERGE, MERGE_WIDTH = 256, 8
WIDE_ABOVE = 64
# Few and short vectors are not worth a merge stage.
DIRECT_VECTORS, DIRECT_BYTES = 16, 32 << 20


def pack(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def summed(df: DataFrame, fn: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """Sum of the vectors ``fn`` returns per batch, over all rows."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                value = fn(batch)
                total = value if total is None else total + value
        if total is not None:
            yield pd.DataFrame({"g": [total.tobytes()]})

    return _merged(df.mapInPandas(partial, "g binary"))


def _merged(parts: DataFrame) -> np.ndarray:
    def merge(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [sum(np.frombuffer(b) for b in g["g"]).tobytes()]})

    wide = parts.sparkSession.sparkContext.defaultParallelism > WIDE_ABOVE
    for width in (WIDE_MERGE, MERGE_WIDTH) if wide else (MERGE_WIDTH,):
        # Partition numbers follow the slots of the stage before, so each stage merges evenly.
        parts = parts.withColumn("_slot", F.spark_partition_id() % width).groupBy("_slot").applyInPandas(merge, "g binary")
    return _collected(parts)


def _collected(parts: DataFrame) -> np.ndarray:
    rows = parts.collect()
    if not rows:
        raise ValueError("no rows to train on")
    return sum(np.frombuffer(bytes(r["g"])) for r in rows)


# ---- statistics of a whole batch ------------------------------------------------------------------

Gather = Callable[[np.ndarray], np.ndarray]


def alone(value: np.ndarray) -> np.ndarray:
    """The vectors of all tasks, one a row, where there is one task only."""
    return value[None]


def gathered(value: np.ndarray) -> np.ndarray:
    """The vectors that all tasks of the barrier stage hand in at this point, one a row, in task order."""
    told = BarrierTaskContext.get().allGather(base64.b64encode(value.astype(float).tobytes()).decode())
    return np.stack([np.frombuffer(base64.b64decode(t)) for t in told])


def batch_moments(a: np.ndarray, gather: Gather = alone) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and variance per column over the rows of all tasks; tasks may be without rows.

    Each task hands in its own mean and squared deviations, so nothing cancels when they are merged.
    """
    width = a.shape[1]
    mean = a.mean(0) if len(a) else np.zeros(width)
    told = gather(np.concatenate([[len(a)], mean, ((a - mean) ** 2).sum(0)]))
    n, means, squares = told[:, :1], told[:, 1:1 + width], told[:, 1 + width:]
    rows = n.sum()
    centre = (n * means).sum(0) / rows
    return int(rows), centre, (squares + n * (means - centre) ** 2).sum(0) / rows


def summed_together(df: DataFrame, tasks: int, key: str, fn: Callable[[pd.DataFrame, Gather], np.ndarray]) -> np.ndarray:
    """Sum over ``tasks`` tasks of what ``fn`` returns for all rows of its task.

    ``fn`` gets a function that gathers a vector of each task, which every task has to call equally
    often, those without rows too. Tasks hold their share of ``df`` in memory: pass one training batch.
    The stage starts when ``tasks`` slots are free and is repeated as a whole if an executor is lost.
    Spark runs no barrier stages under dynamic allocation, and looks for the answers of the other tasks
    once a second, so that each gathering takes about a second.
    """
    if df.isEmpty():
        raise ValueError("no rows to train on")
    empty = pd.DataFrame({c: [] for c in df.columns})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        value = fn(pd.concat(held, ignore_index=True) if held else empty, gathered)
        yield pd.DataFrame({"g": [value.tobytes()]})

    # A stated count is kept by the adaptive planner, so the stage never asks for more slots than told.
    return _merged(df.repartition(tasks, key).mapInPandas(partial, "g binary", barrier=True))


def summed_groups(df: DataFrame, tasks: int, group: str, size: int, fn: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """Sum over the values of the column ``group`` of the ``size`` numbers that ``fn`` returns for all rows of that group.

    Tasks hold their share of ``df`` in memory: pass one training batch, in groups of bounded size.
    """
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            groups = pd.concat(held, ignore_index=True).groupby(group, sort=True)
            yield pd.DataFrame({"g": [sum(fn(rows) for _, rows in groups).tobytes()]})

    parts = df.repartition(tasks, group).mapInPandas(partial, "g binary")
    return _collected(parts) if tasks <= DIRECT_VECTORS and tasks * size * 8 <= DIRECT_BYTES else _merged(parts)


class Adam:
    def __init__(self, lr: float, size: int, decay: tuple[float, float] = (0.9, 0.999)):
        self.lr, self.decay, self.t = lr, decay, 0
        self.m, self.v = np.zeros(size), np.zeros(size)

    def step(self, x: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        a, b = self.decay
        self.m = a * self.m + (1 - a) * grad
        self.v = b * self.v + (1 - b) * grad * grad
        m, v = self.m / (1 - a ** self.t), self.v / (1 - b ** self.t)
        return x - self.lr * m / (np.sqrt(v) + 1e-8)


def keyed_uniform(keys: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Uniform numbers that depend on row key, column and seed only (splitmix64)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        x = x + np.arange(1, width + 1, dtype=np.uint64)[None] * np.uint64(0xD1342543DE82EF95)
        x = x + np.uint64(seed) * np.uint64(0x2545F4914F6CDD1D)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53


def keyed_normal(keys: np.ndarray, width: int, seed: int) -> np.ndarray:
    u = keyed_uniform(keys, 2 * width, seed)
    return np.sqrt(-2 * np.log(u[:, :width])) * np.cos(2 * np.pi * u[:, width:])
