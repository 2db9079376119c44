"""Sampling whose outcome depends on row ids and a seed only, never on partitioning."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.operators.ranking import hash_order, hash_uniform, row_numbers
from tissuegrid.session import materialize, release, stage_root


def _hash_int(key: Column, seed: int) -> Column:
    return F.conv(F.substring(hash_order(key, seed), 1, 13), 16, 10).cast("long")


def _top_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    # The rank filter is pushed below the shuffle, so a map task ships at most n rows per key.
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("_rn") <= n).drop("_rn")


def sample_per_class(types: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``n`` cells of each class, without replacement."""
    return _top_per_key(types, "cell_type", [hash_order(F.col("id"), seed), F.col("id")], n)


def sample_if_large(types: DataFrame, limit: int, n: int, seed: int) -> DataFrame:
    """Subsample every class to ``n`` as soon as any class exceeds ``limit``."""
    largest = types.groupBy("cell_type").count().agg(F.max("count")).first()[0]
    return types if largest is None or largest <= limit else sample_per_class(types, n, seed)


def sample_rows(df: DataFrame, key: Column, n: int, seed: int) -> DataFrame:
    """``n`` rows in hash order: each task keeps its own ``n`` best before the merge."""
    ids = [F.col(c) for c in df.columns]
    return df.orderBy(hash_order(key, seed), *ids).limit(n)


def cap_per_spot(pairs: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``n`` cells per spot; the sampling itself is the operator's purpose."""
    return _top_per_key(pairs, "spot_id", [hash_order(F.col("cell_id"), seed), F.col("cell_id")], n)


def initial_labels(nodes: DataFrame, known: str, n_classes: int, seed: int) -> DataFrame:
    """Known label, else a reproducible draw."""
    drawn = _hash_int(F.col("id"), seed) % n_classes
    return nodes.withColumn("label", F.coalesce(F.col(known).cast("long"), drawn))


def random_mix(counts: DataFrame, mixes: DataFrame, k: int, k_min: int, seed: int = 0) -> DataFrame:
    """Pseudo-spots: each ``mix_id`` is a convex blend of up to ``k`` cells drawn with replacement.

    Between 0 and ``k - k_min`` of the draws are switched off before weights are normalised.
    """
    ids = row_numbers(counts.select("id").distinct(), [F.col("id")], "_rn")
    ids = materialize(ids.select("id", (F.col("_rn") - 1).alias("_ix")), "ids")
    n = ids.agg(F.count("*")).scalar()
    slot = F.concat_ws("-", F.col("mix_id").cast("string"), F.col("_j").cast("string"))
    per_mix = Window.partitionBy("mix_id")  # k rows
    drawn = (
        mixes.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .withColumn("_ix", _hash_int(slot, seed + 1) % n)
        .withColumn("_w", hash_uniform(slot, seed + 2))
        .withColumn("_pos", F.row_number().over(per_mix.orderBy(hash_order(slot, seed + 3), "_j")))
        .where(F.col("_pos") > _hash_int(F.col("mix_id"), seed + 4) % (k - k_min + 1))
        .withColumn("_w", F.col("_w") / F.sum("_w").over(per_mix))
    )
    chosen = drawn.join(ids, "_ix").select("mix_id", "id", "_w")
    return chosen.join(counts, "id").groupBy("mix_id", "gene").agg(
        F.sum(F.col("_w") * F.col("value")).alias("value")
    )


def _near_first_axis(x: np.ndarray, picks: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x`` in the order of their first axis, and for each pick the slice of them within ``reach`` along it."""
    order = np.argsort(x[:, 0], kind="stable")
    edge = reach + 1e-9 * (reach + np.abs(picks[:, 0]))
    return (order, np.searchsorted(x[order, 0], picks[:, 0] - edge),
            np.searchsorted(x[order, 0], picks[:, 0] + edge, "right"))


def _shrink_gaps(picks):
    """Column function: distance to the nearest pick so far, given a broadcast of new picks and their gaps.

    A pick was the farthest point of all, so it changes nothing beyond its own gap.
    """

    @F.pandas_udf("double")
    def shrink(v: pd.Series, gap: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy())
        fresh, reach = picks.value
        order, low, high = _near_first_axis(x, fresh, reach)
        x, out = x[order], gap.to_numpy()[order]
        for i in np.flatnonzero(low < high):
            a, b = low[i], high[i]
            out[a:b] = np.minimum(out[a:b], np.sqrt(((x[a:b] - fresh[i]) ** 2).sum(1)))
        back = np.empty_like(out)
        back[order] = out
        return pd.Series(back)

    return shrink


def batch_rows(n_points: int) -> int:
    """Points that come to the driver in a pass: a share of all, so that passes do not grow with the table; bounded."""
    return min(max(4096, n_points // 8), 1 << 16)


def farthest_points(points: DataFrame, n: int, batch: int | None = None) -> DataFrame:
    """Farthest-point sampling from the lowest id: ``(id, pick)`` with ``pick = 1 .. n``.

    The rule is sequential, but many picks fit in one pass: the ``batch`` points that are now
    farthest come to the driver, and picking among them is exact for as long as the best one
    beats every point left behind, whose distances can only shrink. A pick is compared only with
    points that lie within its gap along the first axis. Picks are appended to a
    stage table pass by pass, so the driver never holds more than one batch.
    """
    spark = points.sparkSession
    schema = f"id {points.schema['id'].dataType.simpleString()}, pick long"
    path = f"{stage_root(spark)}/picks-{uuid.uuid4().hex}"

    def keep(ids: list, done: int) -> None:
        rows = [(i.item() if hasattr(i, "item") else i, done + k) for k, i in enumerate(ids, 1)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    first = points.orderBy("id").select("id", "v").limit(1).collect() if n > 0 else []
    keep([r["id"] for r in first], 0)
    done, fresh, reach = len(first), np.array([r["v"] for r in first], float), np.full(len(first), np.inf)
    batch = batch or batch_rows(points.count())
    state = points.select("id", "v", F.lit(float("inf")).alias("gap"))
    stage = None
    while 0 < done < n:
        shrink = _shrink_gaps(spark.sparkContext.broadcast((fresh, reach)))
        new = materialize(state.select("id", "v", shrink("v", "gap").alias("gap")), "gaps")
        if stage is not None:
            release(stage)
        state = stage = new
        top = state.orderBy(F.col("gap").desc(), "id").limit(batch).toPandas()
        bound = top["gap"].iloc[-1] if len(top) == batch else -1.0
        top = top.sort_values("id", kind="stable")
        ids, v, gap = top["id"].to_numpy(), np.stack(top["v"].to_numpy()), top["gap"].to_numpy().copy()
        picks: list[int] = []
        order = np.argsort(v[:, 0], kind="stable")
        along, spots, reach = v[order, 0], v[order], []
        while done + len(picks) < n:
            best = int(gap.argmax())
            if picks and gap[best] <= bound:
                break
            picks.append(best)
            reach.append(gap[best])
            edge = gap[best] + 1e-9 * (gap[best] + abs(v[best, 0]))
            a, b = along.searchsorted(v[best, 0] - edge), along.searchsorted(v[best, 0] + edge, "right")
            near = order[a:b]
            gap[near] = np.minimum(gap[near], np.sqrt(((spots[a:b] - v[best]) ** 2).sum(1)))
        keep(list(ids[picks]), done)
        done, fresh, reach = done + len(picks), v[picks], np.array(reach)
    return spark.read.schema(schema).parquet(path)
