"""Order statistics and running sums that never gather a key, or the whole table, in one task.

Rows are range-partitioned by ``(keys, order)``. Each chunk contributes one total per key, the
totals (at most chunks + keys rows) are prefix-summed, and the rest is a window inside a chunk.
A key holding most of the rows simply spans many chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.session import materialize


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: Column, out: str
) -> DataFrame:
    """Add ``out``: inclusive sum of ``weight`` over rows up to this one, per key.

    ``order`` must be a total order within a key for a repeatable answer.
    """
    key_cols = [F.col(k) for k in keys]
    chunked = df.repartitionByRange(*key_cols, *order).withColumn("_chunk", F.spark_partition_id())
    # Range bounds come from a sample, so pin the chunk ids before reading them twice.
    chunked = materialize(chunked.withColumn("_w", weight), "chunks")
    totals = chunked.groupBy(*keys, "_chunk").agg(F.sum("_w").alias("_t"))
    earlier = Window.partitionBy(*(key_cols or [F.lit(0)])).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *keys, "_chunk", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_chunk", *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = chunked.withColumn("_local", F.sum("_w").over(inside))
    return (
        local.join(offsets, [*keys, "_chunk"])
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_before", "_local", "_chunk", "_w")
    )


def row_numbers(
    df: DataFrame, order: Sequence[Column], out: str = "rn", keys: Sequence[str] = ()
) -> DataFrame:
    """1-based position of each row in a total order, per key or over the whole table."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), out)


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    keys: Sequence[str] = (),
    weight: str | None = None,
    n_offset: int = 0,
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per key, one column per entry of ``probs``.

    ``weight`` is a multiplicity column. ``n_offset`` is added to the sample size when positions
    are computed, for callers that pass only the low end of a larger sample.
    """
    mult = F.col(weight) if weight else F.lit(1)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.sum(mult).cast("long").alias("_n"))
    )
    # One pass over the data; the value histogram feeds both the ranks and the totals.
    ranked = running_sum(counted, keys, [F.col(value)], F.col("_n"), "_cum")
    totals = ranked.groupBy(*keys).agg((F.sum("_n") + F.lit(n_offset)).alias("_total"))
    if keys:
        sized = ranked.join(totals, list(keys))
    else:
        sized = ranked.withColumn("_total", totals.select("_total").scalar())
    aggs, finals = [], []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [
            F.min(F.when(F.col("_cum") > lo, F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_cum") > hi, F.col(value))).alias(f"_hi_{name}"),
            F.max(pos - lo).alias(f"_f_{name}"),
        ]
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        finals.append((low + (high - low) * F.col(f"_f_{name}")).cast("double").alias(name))
    return sized.groupBy(*keys).agg(*aggs).select(*keys, *finals)


def median(df: DataFrame, value: str, out: str = "median", keys: Sequence[str] = ()) -> DataFrame:
    return quantiles(df, value, {out: 0.5}, keys)


def hash_order(key: Column, seed: int) -> Column:
    """Reproducible random sort key of a row: depends on its id and the seed, not on its partition."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def hash_uniform(key: Column, seed: int) -> Column:
    """Reproducible uniform number in [0, 1) from the leading 52 bits of the hash."""
    head = F.conv(F.substring(hash_order(key, seed), 1, 13), 16, 10).cast("double")
    return head / F.lit(float(2**52))
