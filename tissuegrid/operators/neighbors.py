"""Exact nearest-neighbour and radius joins.

``knn_join`` has four physical forms with one result:

* few references (row and byte bound checked first): the references are broadcast and every
  task scores its own queries, with no exchange at all;
* points in at most three dimensions: locations are ordered along a space-filling curve and cut into
  blocks of equal size, so a crowded place only gives more blocks. A query first meets the block at its
  own place; the distance found there tells which other blocks' boxes it still has to meet;
* in more dimensions, where pivots rule out next to nothing: blocks of bounded size meet in a co-grouped
  task, every block of queries each block of references once; a task goes outwards from the middle of its
  queries and stops where nothing nearer can follow;
* otherwise (ties, cosine in few dimensions): references are assigned to pivots, each query derives an
  upper bound of its k-th distance from pivot statistics, probes only the pivot cells the triangle and
  half-space inequalities cannot rule out, and blocks of bounded size meet in a co-grouped task.

In the last two, copies of one location are folded into one row first, so a pile of duplicates costs as
much as one row.

Order is ``(distance rounded to 10 digits, id)``, so ties do not depend on the physical form.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tissuegrid.operators.ranking import quantiles
from tissuegrid.session import materialize

DIGITS = 10
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 4096
QUERY_ROWS = 8192
GRID_AXES = 3
GRID_ROWS = 512
MAX_BLOCKS = 1 << 20
MAX_PIVOTS = 16_384
PIVOT_BYTES = 128 << 20
DENSE_BYTES = 64 << 20
DENSE_PAIRS = 1 << 29


# ---- kernels ------------------------------------------------------------------------------

def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _unit(v: np.ndarray, extra: int) -> np.ndarray:
    """Unit rows with two more axes: a zero query (0) or reference (1) gets an axis of its own.

    Every row then has length one, and a zero row keeps cosine 0 to everything.
    """
    size = np.sqrt((v * v).sum(1, keepdims=True))
    out = v / np.where(size == 0, 1.0, size)
    pad = np.zeros((len(v), 2))
    pad[size[:, 0] == 0, extra] = 1.0
    return np.hstack([out, pad])


def _squared(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    if q.shape[1] <= 4:
        out = np.zeros((len(q), len(r)))
        gap = np.empty_like(out)
        for d in range(q.shape[1]):
            np.subtract(q[:, d, None], r[None, :, d], out=gap)
            gap *= gap
            out += gap
        return out
    return np.maximum((q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2 * (q @ r.T), 0.0)


def nearest(q: np.ndarray, r: np.ndarray, k: int, metric: str, ties: bool = False,
            limit: np.ndarray | None = None):
    """Per query row the ``k`` first reference rows by (rounded distance, position).

    Yields ``(query position, reference position, distance, rank)`` arrays per slice. Distances
    of the finalists are recomputed pairwise, so the fast product form only preselects.
    ``limit`` is an upper bound of each query's k-th Euclidean distance over all references; where
    it leaves few candidates it saves the partial sort.
    """
    if not len(r) or not len(q):
        return
    step = max(1, 2_000_000 // len(r))
    if q.shape[1] <= 4:
        # Small slices stay in the processor's cache.
        step = min(step, max(64, 65_536 // len(r)))
    rmax = float((r * r).sum(1).max())
    for start in range(0, len(q), step):
        part = q[start:start + step]
        d2 = _squared(part, r)
        close = None if limit is None else d2 <= (limit[start:start + step] ** 2)[:, None]
        if close is not None and np.count_nonzero(close) <= 4 * k * len(part):
            qi, ri = np.nonzero(close)
        elif len(r) > k:
            kth = np.partition(d2, k - 1, axis=1)[:, k - 1]
            slack = 1e-9 * (1.0 + kth + rmax + (part * part).sum(1))
            qi, ri = np.nonzero(d2 <= (kth + slack)[:, None])
        else:
            qi, ri = np.nonzero(np.ones_like(d2, dtype=bool))
        if metric == "cosine":
            dist = 1.0 - np.einsum("ij,ij->i", part[qi], r[ri])
        else:
            dist = np.sqrt(((part[qi] - r[ri]) ** 2).sum(1))
        dist = np.round(dist, DIGITS) + 0.0
        order = np.lexsort((ri, dist, qi))
        qi, ri, dist = qi[order], ri[order], dist[order]
        first = np.searchsorted(qi, np.arange(len(part)))
        rank = np.arange(len(qi)) - first[qi]
        keep = rank < k
        if ties and len(dist):
            # Position of the k-th entry of each query; queries without k entries keep all.
            at = np.minimum(first + k - 1, len(dist) - 1)
            keep |= dist <= dist[at][qi]
        yield qi[keep] + start, ri[keep], dist[keep], rank[keep] + 1


def closest(q: np.ndarray, r: np.ndarray, k: int, metric: str, ties: bool = False, first: int = 4096):
    """As ``nearest``, for large blocks of many dimensions; non-finite rows take no part.

    References are taken by their distance from the middle of the queries, in stretches that double. After each
    the k-th score so far is the least that a later row must reach, and where no later row can, the search ends.
    Scores only preselect, with a slack above their rounding error; finalists are measured in double precision.
    """
    asking, held = (np.flatnonzero(np.isfinite(v).all(1)) for v in (q, r))
    if not len(asking) or not len(held):
        return
    q, r = q[asking], r[held]
    centre = q.mean(0)
    gap = np.sqrt(((q - centre) ** 2).sum(1))
    away = np.sqrt(((r - centre) ** 2).sum(1))
    order = np.argsort(away, kind="stable")
    r, away, held = r[order], away[order], held[order]
    if metric == "cosine":
        left, right = q.astype(np.float32), r.astype(np.float32)
        base, slack = np.full(len(q), 2.0), np.full(len(q), (q.shape[1] + 8) * 2.0 ** -23)
    else:
        # Squared distance = |q|^2 - 2 * score.
        size = (r * r).sum(1)
        left, right = np.hstack([q, np.ones((len(q), 1))]), np.hstack([r, -size[:, None] / 2])
        base = (q * q).sum(1)
        slack = 1e-9 * (1.0 + base + size.max())

    def measured(qi, ri):
        """Finalists among candidates: the first ``k`` of each query."""
        if metric == "cosine":
            dist = 1.0 - np.einsum("ij,ij->i", part[qi], r[ri])
        else:
            dist = np.sqrt(((part[qi] - r[ri]) ** 2).sum(1))
        dist = np.round(dist, DIGITS) + 0.0
        by = np.lexsort((held[ri], dist, qi))
        qi, ri, dist = qi[by], ri[by], dist[by]
        begin = np.searchsorted(qi, np.arange(len(part)))
        rank = np.arange(len(qi)) - begin[qi]
        keep = rank < k
        if ties and len(dist):
            keep |= dist <= dist[np.minimum(begin + k - 1, len(dist) - 1)][qi]
        return qi[keep], ri[keep], dist[keep], rank[keep] + 1

    rows, cols = 512, 2048
    block, hits = np.empty(rows * cols, dtype=left.dtype), np.empty(rows * cols, dtype=bool)

    def reaching(a, b):
        """Flat positions of the scores of references ``a`` to ``b`` that reach ``least``, and those scores."""
        if a == 0:
            near = ask @ right[:b].T
            return near, np.flatnonzero(near >= least[:, None])
        near = block[:len(ask) * (b - a)].reshape(len(ask), b - a)
        over = hits[:near.size]
        np.matmul(ask, right[a:b].T, out=near)
        np.greater_equal(near, least[:, None], out=over.reshape(near.shape))
        if near.size % 8:
            return near, np.flatnonzero(over)
        # Hits are rare: eight at a time.
        cells = np.flatnonzero(over.view(np.uint64))[:, None] * 8 + np.arange(8)
        return near, cells[over[cells]]

    for s in range(0, len(q), rows):
        part, ask = q[s:s + rows], left[s:s + rows]
        loose = slack[s:s + rows]
        least = np.full(len(part), -np.inf, dtype=left.dtype)
        qi, ri, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=left.dtype)
        start, stop = 0, min(max(first, 4 * k), len(r))
        while start < len(r):
            found = [(qi, ri, score)]
            if not start and stop > k:
                least = np.partition(ask @ right[:stop].T, stop - k, axis=1)[:, stop - k] - 2 * loose
                least = np.nextafter(least.astype(left.dtype), -np.inf, dtype=left.dtype)
            for a in range(start, stop, cols if start else stop):
                near, at = reaching(a, min(a + cols, stop) if start else stop)
                i, j = np.divmod(at, near.shape[1])
                found.append((i, j + a, near.ravel()[at]))
                if sum(len(f[0]) for f in found[1:]) > 2_000_000:
                    # Very many equal scores: only the first by distance and id stay.
                    i, j, x = (np.concatenate(f) for f in zip(*found))
                    by = np.lexsort((j, i))
                    i, j, x = i[by], j[by], x[by]
                    keep_i, keep_j, _, _ = measured(i, j)
                    place = np.searchsorted(i * len(r) + j, keep_i * len(r) + keep_j)
                    found = [(i[place], j[place], x[place])]
            qi, ri, score = (np.concatenate(f) for f in zip(*found))
            count = np.bincount(qi, minlength=len(part))
            if start and count.max() >= k:
                by = np.argsort(qi, kind="stable")
                qi, ri, score = qi[by], ri[by], score[by]
                table = np.full((len(part), count.max()), -np.inf, dtype=left.dtype)
                table[qi, np.arange(len(qi)) - (np.cumsum(count) - count)[qi]] = score
                least = np.partition(table, table.shape[1] - k, axis=1)[:, table.shape[1] - k] - 2 * loose
                least = np.nextafter(least.astype(left.dtype), -np.inf, dtype=left.dtype)
                stays = score >= least[qi]
                qi, ri, score = qi[stays], ri[stays], score[stays]
            start, stop = stop, min(2 * stop, len(r))
            if start < len(r):
                reach = np.sqrt(np.maximum(base[s:s + rows] - 2.0 * least.astype(float) + 2 * loose, 0.0))
                if (gap[s:s + rows] + reach).max() * (1 + 1e-9) + 1e-9 < away[start]:
                    break
        i, j, dist, rank = measured(qi, ri)
        yield asking[i + s], held[j], dist, rank


# ---- public join ----------------------------------------------------------------------------

def knn_join(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    metric: str = "euclidean",
    by: str | None = None,
    exclude_self: bool = False,
    ties: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(id, v)`` against ``(id, v)`` -> ``(query_id, ref_id, distance, rank)``.

    ``by`` names a column both sides must share; ``exclude_self`` drops ``ref_id = query_id``;
    ``ties`` keeps every reference at the k-th distance. Fewer than ``k`` references give fewer
    rows. ``metric`` is ``euclidean`` or ``cosine`` (distance ``1 - cos``).
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    cls = F.col(by) if by else F.lit(0)
    q = queries.select("id", "v", cls.alias("cls"))
    # Computed once: its size decides the form, and either form reads it again.
    r = materialize(refs.select("id", "v", cls.alias("cls")), "references")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    head = r.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.min(F.size("v")).alias("least"),
                 F.max(odd).alias("odd"), *[F.min(F.get("v", F.lit(i))).alias(f"lo{i}") for i in range(GRID_AXES)],
                 *[F.max(F.get("v", F.lit(i))).alias(f"hi{i}") for i in range(GRID_AXES)]).first()
    small = head["n"] <= broadcast_rows and head["n"] * (head["d"] or 0) * 8 <= BROADCAST_BYTES
    if small:
        return _broadcast_knn(q, r, k, metric, exclude_self, ties)
    plane = metric == "euclidean" and not ties and 0 < head["least"] == head["d"] <= GRID_AXES and not head["odd"]
    if plane:
        box = [(head[f"lo{i}"], head[f"hi{i}"]) for i in range(head["d"])]
        found = _curve_knn(q, r, k, exclude_self, box, head["n"], min(block_rows, GRID_ROWS), queries is refs)
        if found is not None:
            return found
    if (head["d"] or 0) > GRID_AXES:
        return _dense_knn(q, r, k, metric, exclude_self, ties, head["d"], block_rows)
    return _blocked_knn(q, r, k, metric, exclude_self, ties, head["d"], block_rows)


def _result_schema(q: DataFrame, r: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", q.schema["id"].dataType), T.StructField("ref_id", r.schema["id"].dataType),
        T.StructField("distance", T.DoubleType()), T.StructField("rank", T.LongType()),
    ])


def _broadcast_knn(q, r, k, metric, exclude_self, ties) -> DataFrame:
    want = k + 1 if exclude_self else k
    table = r.toPandas().sort_values("id", kind="stable")
    groups = {}
    for c, g in table.groupby("cls", sort=False):
        v = _matrix(g["v"])
        groups[c] = (g["id"].to_numpy(), _unit(v, 1) if metric == "cosine" else v)
    shared = q.sparkSession.sparkContext.broadcast(groups)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c, g in batch.groupby("cls", sort=False):
                if c not in shared.value:
                    continue
                ids, ref = shared.value[c]
                own = g["id"].to_numpy()
                v = _matrix(g["v"])
                for qi, ri, dist, rank in nearest(
                    _unit(v, 0) if metric == "cosine" else v, ref, want, metric, ties
                ):
                    out = pd.DataFrame({"query_id": own[qi], "ref_id": ids[ri],
                                        "distance": dist, "rank": rank})
                    if exclude_self:
                        out = out[out["query_id"] != out["ref_id"]]
                        out["rank"] = out.groupby("query_id", sort=False).cumcount() + 1
                        if not ties:
                            out = out[out["rank"] <= k]
                    yield out

    return q.mapInPandas(score, _result_schema(q, r))


def _folded(q, r, want, ties) -> tuple[DataFrame, DataFrame]:
    """Locations ``(cls, v, loc, ids)`` of the references and ``(cls, v, ask)`` of the queries."""
    # Fold copies of a location; only its lowest ids can ever be among the nearest.
    if ties:
        locs = r.select("cls", "v", F.col("id").alias("loc"), F.array("id").alias("ids"))
    else:
        rn = F.row_number().over(Window.partitionBy("cls", "v").orderBy("id"))
        low = r.withColumn("_rn", rn).where(F.col("_rn") <= want)
        locs = low.groupBy("cls", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        locs = locs.withColumn("loc", F.col("ids")[0])
    locs = materialize(locs, "locations")
    asks = materialize(
        q.select("cls", "v").distinct().withColumn("ask", F.monotonically_increasing_id()), "asks"
    )
    return locs, asks


def _blocked_knn(q, r, k, metric, exclude_self, ties, dim, block_rows) -> DataFrame:
    spark = q.sparkSession
    want = k + 1 if exclude_self else k
    id_type = r.schema["id"].dataType
    cls_type = r.schema["cls"].dataType

    locs, asks = _folded(q, r, want, ties)
    sizes = locs.agg(F.count("*").alias("n"), F.count_distinct("cls").alias("c")).first()
    per_pivot = 8 * (dim + 2 + sizes["c"] * (want + 3))
    # About a quarter block of locations per pivot and class: fine enough to prune, few groups.
    wanted = math.ceil(4 * sizes["n"] / (block_rows * max(sizes["c"], 1)))
    n_pivots = max(1, min(wanted, MAX_PIVOTS, PIVOT_BYTES // per_pivot))
    picked = locs.orderBy(F.xxhash64("v"), "loc").select("v").limit(n_pivots).toPandas()
    pivots = _matrix(picked["v"])
    pivots = spark.sparkContext.broadcast(_unit(pivots, 1) if metric == "cosine" else pivots)

    def place(v: np.ndarray, side: int) -> np.ndarray:
        return _unit(v, side) if metric == "cosine" else v

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d2 = _squared(place(_matrix(batch["v"]), 1), pivots.value)
            best = d2.argmin(1)
            yield batch.assign(pivot=best.astype("int32"), gap=np.sqrt(d2[np.arange(len(best)), best]))

    fields = [locs.schema[c] for c in ("cls", "v", "loc")]
    placed = locs.select("cls", "v", "loc").mapInPandas(
        assign, T.StructType([*fields, T.StructField("pivot", T.IntegerType()), T.StructField("gap", T.DoubleType())])
    )
    placed = materialize(placed, "placed")
    cell_stats = placed.groupBy("cls", "pivot").agg(F.count("*").alias("n"), F.max("gap").alias("reach"))
    by_gap = F.row_number().over(Window.partitionBy("cls", "pivot").orderBy("gap"))
    close = (
        placed.select("cls", "pivot", "gap").withColumn("_rn", by_gap).where(F.col("_rn") <= want)
        .groupBy("cls", "pivot").agg(F.sort_array(F.collect_list("gap")).alias("close"))
    )
    # At most pivots x classes rows, bounded above.
    stats = cell_stats.join(close, ["cls", "pivot"]).toPandas()
    book = {}
    for c, g in stats.groupby("cls", sort=False):
        near = np.full((len(g), want), np.inf)
        for i, gaps in enumerate(g["close"]):
            near[i, :len(gaps)] = gaps
        book[c] = (g["pivot"].to_numpy(), g["reach"].to_numpy(), near)
    book = spark.sparkContext.broadcast(book)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c, g in batch.groupby("cls", sort=False):
                if c not in book.value:
                    continue
                cell, reach, near = book.value[c]
                spots = pivots.value[cell]
                v = place(_matrix(g["v"]), 0)
                for start in range(0, len(v), 512):
                    part, rows = v[start:start + 512], g.iloc[start:start + 512]
                    dist = np.sqrt(_squared(part, spots))
                    # k-th smallest of "through the pivot" distances bounds the k-th neighbour.
                    m = min(len(cell), 8)
                    some = np.argpartition(dist, m - 1, axis=1)[:, :m]
                    via = (np.take_along_axis(dist, some, 1)[:, :, None] + near[some]).reshape(len(part), -1)
                    bound = np.partition(via, want - 1, axis=1)[:, want - 1]
                    short = ~np.isfinite(bound)
                    if short.any():
                        via = (dist[short][:, :, None] + near[None]).reshape(short.sum(), -1)
                        bound[short] = np.partition(via, want - 1, axis=1)[:, want - 1]
                    home = dist.argmin(1)
                    apart = np.sqrt(_squared(spots[home], spots))
                    own = dist[np.arange(len(part)), home]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        half = (dist ** 2 - own[:, None] ** 2) / (2 * apart)
                    half[~np.isfinite(half)] = -np.inf
                    slack = 1e-6 * (1.0 + bound + own)
                    hit = np.maximum(dist - reach[None], half) <= (bound + slack)[:, None]
                    qi, pi = np.nonzero(hit)
                    out = rows.iloc[qi][["ask", "cls", "v"]].copy()
                    out["pivot"] = cell[pi].astype("int32")
                    limit = bound + slack
                    out["bound"] = (limit ** 2 / 2 if metric == "cosine" else limit)[qi]
                    yield out

    probes = asks.select("ask", "cls", "v").mapInPandas(
        probe, T.StructType([asks.schema["ask"], asks.schema["cls"], asks.schema["v"],
                             T.StructField("pivot", T.IntegerType()), T.StructField("bound", T.DoubleType())])
    )
    probes = materialize(probes, "probes")

    # Work units of bounded size on both sides, however full a cell or however many ask it.
    asked = probes.groupBy("cls", "pivot").agg(F.count("*").alias("asked"))
    units = materialize(cell_stats.join(asked, ["cls", "pivot"]).select(
        "cls", "pivot",
        F.ceil(F.col("n") / block_rows).cast("int").alias("parts"),
        F.ceil(F.col("asked") / QUERY_ROWS).cast("int").alias("chunks"),
    ), "units")
    left = probes.join(units, ["cls", "pivot"]).select(
        "cls", "pivot", F.pmod(F.xxhash64("ask"), "chunks").cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "ask", "v", "bound",
    )
    right = placed.join(units, ["cls", "pivot"]).select(
        "cls", "pivot", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.pmod(F.xxhash64("loc"), "parts").cast("int").alias("part"), "loc", "v",
    )

    def meet(key: tuple[Any, ...], asks_part: pd.DataFrame, locs_part: pd.DataFrame) -> pd.DataFrame:
        locs_part = locs_part.sort_values("loc", kind="stable")
        loc, ask, bound = (x.to_numpy() for x in (locs_part["loc"], asks_part["ask"], asks_part["bound"]))
        found = []
        limit = np.sqrt(2 * bound) if metric == "cosine" else bound
        for qi, ri, dist, _ in nearest(
                place(_matrix(asks_part["v"]), 0), place(_matrix(locs_part["v"]), 1), want, metric, ties, limit * (1 + 1e-9)):
            near = dist <= bound[qi]
            found.append(pd.DataFrame({"ask": ask[qi[near]], "loc": loc[ri[near]], "distance": dist[near]}))
        return pd.concat(found) if found else pd.DataFrame(columns=["ask", "loc", "distance"])

    keys = ["cls", "pivot", "chunk", "part"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        meet, T.StructType([asks.schema["ask"], T.StructField("loc", id_type), T.StructField("distance", T.DoubleType())])
    )
    rank = F.rank() if ties else F.row_number()
    order = [F.col("distance")] if ties else [F.col("distance"), F.col("loc")]
    best = met.withColumn("_rk", rank.over(Window.partitionBy("ask").orderBy(*order))).where(F.col("_rk") <= want)
    # Only locations with copies stand for more than their own id.
    piles = locs.where(F.size("ids") > 1).select("loc", "ids")
    lists = best.join(piles, "loc", "left").select(
        "ask", "distance", F.explode(F.coalesce("ids", F.array("loc"))).alias("ref_id"))
    order = [F.col("distance")] if ties else [F.col("distance"), F.col("ref_id")]
    lists = lists.withColumn("_rk", rank.over(Window.partitionBy("ask").orderBy(*order))).where(F.col("_rk") <= want)
    lists = lists.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("distance", "ref_id"))).alias("found"))
    answered = materialize(asks.join(lists, "ask").select("cls", "v", "found"), "answers")
    return _answers(q, answered, k, exclude_self, ties)


def _answers(q, answered, k, exclude_self, ties) -> DataFrame:
    """``found`` per location and class as rows per query."""
    # Many queries may share a location; the skew-join rule splits such a key.
    out = q.join(answered, ["cls", "v"])
    found = F.col("found")
    if exclude_self:
        found = F.filter(found, lambda x: x["ref_id"] != F.col("id"))
    if not ties:
        found = F.slice(found, 1, k)
    return out.select(F.col("id").alias("query_id"), F.posexplode(found).alias("rank", "hit")).select(
        "query_id", F.col("hit.ref_id").alias("ref_id"), F.col("hit.distance").alias("distance"),
        (F.col("rank") + 1).cast("long").alias("rank"),
    )


def _dense_knn(q, r, k, metric, exclude_self, ties, dim, block_rows) -> DataFrame:
    """Every block of queries meets each block of references of its class once; lists of bounded size are merged."""
    spark = q.sparkSession
    want = k + 1 if exclude_self else k
    locs, asks = _folded(q, r, want, ties)
    fit = max(1, DENSE_BYTES // (8 * (dim + 2)))
    held, asking = min(64 * block_rows, fit), min(16 * block_rows, fit)
    cores = spark.sparkContext.defaultParallelism
    units = asks.groupBy("cls").agg(F.count("*").alias("a")).join(locs.groupBy("cls").agg(F.count("*").alias("n")), "cls")
    # Blocks of queries are cut smaller while there is work for more cores.
    useful = F.least(F.lit(3 * cores), F.floor(F.col("a") * F.col("n") / DENSE_PAIRS))
    units = units.withColumn("parts", F.ceil(F.col("n") / held).cast("int"))
    units = materialize(units.select("cls", "parts", F.greatest(F.ceil(F.col("a") / asking), F.least(
        F.ceil(useful / F.col("parts")), F.ceil(F.col("a") / 512))).cast("int").alias("chunks")), "units")
    total = units.agg(F.sum(F.col("parts").cast("long") * F.col("chunks"))).first()[0] or 1
    left = asks.join(units, "cls").select(
        "cls", F.pmod(F.xxhash64("ask"), "chunks").cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "ask", "v")
    right = locs.join(units, "cls").select(
        "cls", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.pmod(F.xxhash64("loc"), "parts").cast("int").alias("part"), "loc", "v")

    def place(v: np.ndarray, side: int) -> np.ndarray:
        return _unit(v, side) if metric == "cosine" else v

    def meet(key: tuple[Any, ...], asks_part: pd.DataFrame, locs_part: pd.DataFrame) -> pd.DataFrame:
        if not len(asks_part) or not len(locs_part):
            return pd.DataFrame(columns=["ask", "far", "near"])
        locs_part = locs_part.sort_values("loc", kind="stable")
        far, near = _lists(asks_part["ask"], locs_part["loc"].to_numpy(), len(asks_part), closest(
            place(_matrix(asks_part["v"]), 0), place(_matrix(locs_part["v"]), 1), want, metric, ties))
        return asks_part[["ask"]].assign(far=far, near=near)

    keys = ["cls", "chunk", "part"]
    # A fixed count, as the work lies in computing: the adaptive planner would merge small partitions.
    left, right = (side.repartition(max(1, min(3 * total, 64 * cores)), *keys).groupBy(*keys) for side in (left, right))
    met = left.cogroup(right).applyInPandas(meet, T.StructType([
        asks.schema["ask"], T.StructField("far", T.ArrayType(T.DoubleType())), T.StructField("near", T.ArrayType(r.schema["id"].dataType))]))
    hit = F.transform(F.arrays_zip("far", "near"), lambda x: F.struct(x["far"].alias("distance"), x["near"].alias("ref_id")))

    def first(found: "F.Column") -> "F.Column":
        found = F.sort_array(found)
        if not ties:
            return F.slice(found, 1, want)
        last = F.get(found, F.least(F.size(found), F.lit(want)) - 1)["distance"]
        return F.filter(found, lambda x: x["distance"] <= last)

    best = met.where(F.size("near") > 0).groupBy("ask").agg(first(F.flatten(F.collect_list(hit))).alias("found"))
    if not ties:
        # Only locations with copies stand for more than their own id.
        piles = locs.where(F.size("ids") > 1).select("cls", "loc", "ids")
        if piles.limit(1).count():
            each = best.join(asks.select("ask", "cls"), "ask").select("ask", "cls", F.explode("found").alias("hit")).select(
                "ask", "cls", F.col("hit.distance").alias("distance"), F.col("hit.ref_id").alias("loc"))
            each = each.join(piles, ["cls", "loc"], "left").withColumn("ref_id", F.explode(F.coalesce("ids", F.array("loc"))))
            best = each.groupBy("ask").agg(first(F.collect_list(F.struct("distance", "ref_id"))).alias("found"))
    answered = materialize(asks.join(best, "ask").select("cls", "v", "found"), "answers")
    return _answers(q, answered, k, exclude_self, ties)


# ---- points in two and three dimensions -----------------------------------------------------------

def _along_curve(df: DataFrame, axes: list[str], box: list[tuple[float, float]]) -> DataFrame:
    """Adds ``z``, the place on a space-filling curve: the bits of all axes, interleaved; outside ``box`` clipped."""
    bits = 60 // len(axes)
    top = (1 << bits) - 1
    steps = []
    for a, (lo, hi) in zip(axes, box):
        scaled = (F.col(a) - F.lit(lo)) / F.lit((hi - lo) or 1.0) * F.lit(float(top))
        steps.append(F.greatest(F.lit(0), F.least(F.lit(top), F.floor(scaled).cast("long"))).alias(f"_{a}"))
    bit = [F.shiftleft(F.shiftright(F.col(f"_{a}"), i).bitwiseAND(F.lit(1).cast("long")), i * len(axes) + j)
           for i in range(bits) for j, a in enumerate(axes)]
    return df.select("*", *steps).select("*", sum(bit[1:], bit[0]).alias("z")).drop(*[f"_{a}" for a in axes])


def _to_boxes(low: np.ndarray, high: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least distances between boxes ``low..high`` (or points, if equal) and boxes ``lo..hi``."""
    gap = np.maximum(np.maximum(lo[None] - high[:, None], low[:, None] - hi[None]), 0.0)
    return np.sqrt((gap * gap).sum(2))


def _enough(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, want: int) -> np.ndarray:
    """Radius around each point within which whole boxes hold ``want`` locations; infinite if all hold fewer."""
    out = np.full(len(q), np.inf)
    if n.sum() < want:
        return out
    step = max(1, 1_000_000 // len(n))
    for s in range(0, len(q), step):
        far = np.maximum(np.abs(q[s:s + step, None] - lo[None]), np.abs(q[s:s + step, None] - hi[None]))
        far = np.sqrt((far * far).sum(2))
        order = np.argsort(far, axis=1)
        last = (np.cumsum(n[order], axis=1) < want).sum(1)
        out[s:s + step] = np.take_along_axis(far, np.take_along_axis(order, last[:, None], 1), 1)[:, 0]
    return out


def _lists(asks: np.ndarray, loc: np.ndarray, size: int, parts) -> tuple[list, list]:
    """Per asking row the distances and ids that ``nearest`` found, as lists."""
    far, near = [np.zeros(0)] * size, [loc[:0]] * size
    for qi, ri, dist, _ in parts:
        cut = np.flatnonzero(np.diff(qi)) + 1
        for i, a, b in zip(qi[np.r_[0, cut]] if len(qi) else [], np.r_[0, cut], np.r_[cut, len(qi)]):
            far[i], near[i] = dist[a:b], loc[ri[a:b]]
    return far, near


def _flat_hits(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query position, reference position and distance of all that ``nearest`` found, in its order."""
    found = [p[:3] for p in parts]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def _list_column(count: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Lists of ``count`` values each, taken from ``values`` in a row."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], type=pa.int32()), values)


def _curve_knn(q, r, k, exclude_self, box, size, block_rows, same) -> DataFrame | None:
    """Blocks along the curve; None if classes are too many for the table of their boxes."""
    spark = q.sparkSession
    want = k + 1 if exclude_self else k
    axes = [f"x{i}" for i in range(len(box))]
    spots = [F.col("v")[i].cast("double").alias(a) for i, a in enumerate(axes)]
    q = q.where("cls IS NOT NULL AND v IS NOT NULL").select("id", "cls", *spots)
    r = r.where("cls IS NOT NULL").select("id", "cls", *spots)
    place = ["cls", *axes]

    # Copies of a location are folded; those with copies get their lists of ids at the end.
    locs = r.groupBy(*place).agg(F.min("id").alias("loc"), F.count("*").alias("copies"))
    locs = _along_curve(locs, axes, box)
    rows = max(block_rows, math.ceil(size / MAX_BLOCKS))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        base, row, last, inside, block = TaskContext.get().partitionId() << 40, 0, None, 0, 0
        for batch in batches:
            if not len(batch):
                continue
            cls = batch["cls"].to_numpy()
            fresh = np.r_[row == 0 or cls[0] != last, cls[1:] != cls[:-1]].astype(bool)
            at = np.arange(len(cls))
            start = np.maximum.accumulate(np.where(fresh, at, -1))
            pos = np.where(start >= 0, at - start, at + inside)
            opens = pos % rows == 0
            first = np.maximum.accumulate(np.where(opens, at + row, -1))
            first = np.where(first >= 0, first, block)
            yield batch.assign(ask=base + row + at, block=base + first)
            row, last, inside, block = row + len(cls), cls[-1], int(pos[-1]) + 1, int(first[-1])

    longs = [T.StructField(c, T.LongType()) for c in ("ask", "block")]
    table = locs.repartitionByRange("cls", "z", *axes).sortWithinPartitions("cls", "z", *axes)
    cut = table.mapInPandas(number, T.StructType([*locs.schema, *longs]))
    cut = materialize(cut, "blocks")
    boxes = cut.groupBy("cls", "block").agg(
        F.count("*").alias("n"), F.max("copies").alias("copies"), F.min("z").alias("z"), *[F.min(a).alias(f"lo_{a}") for a in axes],
        *[F.max(a).alias(f"hi_{a}") for a in axes]).limit(4 * MAX_BLOCKS + 1).toPandas()
    if len(boxes) > 4 * MAX_BLOCKS:
        return None
    names, starts, entries = {}, [], []
    # Blocks are numbered class by class.
    for c, g in boxes.sort_values("block").groupby("cls", sort=False):
        names[c] = len(entries)
        starts.append(g["block"].iloc[0])
        entries.append((g["block"].to_numpy(), g["z"].to_numpy(), g["n"].to_numpy(),
                        g[[f"lo_{a}" for a in axes]].to_numpy(float), g[[f"hi_{a}" for a in axes]].to_numpy(float)))
    book = spark.sparkContext.broadcast((names, np.array(starts, dtype=np.int64), entries))

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, _, entries = book.value
            for c, g in batch.groupby("cls", sort=False):
                if c in names:
                    block, z = entries[names[c]][:2]
                    yield g.assign(block=block[np.maximum(np.searchsorted(z, g["z"].to_numpy(), "right") - 1, 0)])

    if same:
        asks = cut.select("ask", *place, "block")
    else:
        asks = q.select(*place).distinct().withColumn("ask", F.monotonically_increasing_id())
        asks = _along_curve(asks, axes, box)
        asks = materialize(asks.mapInPandas(home, T.StructType([*asks.schema, longs[1]])).drop("z"), "asks")

    # About 64 blocks a task; on small tables at least one task a core.
    tasks = max(1, len(boxes) // 64, min(len(boxes), spark.sparkContext.defaultParallelism))
    id_type = r.schema["id"].dataType
    lists = [T.StructField("far", T.ArrayType(T.DoubleType())), T.StructField("near", T.ArrayType(id_type))]

    def points(table: pa.Table) -> np.ndarray:
        return np.column_stack([table[a].to_numpy().astype(float) for a in axes])

    def found_in(asking: pa.Table, held: pa.Table, limit: np.ndarray | None = None):
        """Per asking row how many of ``held`` were found; all their distances and ids in a row."""
        held = held.sort_by("loc")
        qi, ri, dist = _flat_hits(nearest(points(asking), points(held), want, "euclidean", limit=limit))
        near = held["loc"].combine_chunks().take(pa.array(ri))
        return np.bincount(qi, minlength=asking.num_rows), dist, near

    def first(key: tuple[Any, ...], asking: pa.Table, held: pa.Table) -> pa.Table:
        names = ["ask", *place, "far", "near", "bound", "more"]
        v, (count, dist, near) = points(asking), found_in(asking, held)
        if not len(v):
            return pa.table([*[asking[c] for c in ("ask", *place)], _list_column(count, pa.array(dist)), _list_column(count, near),
                             pa.array(dist), _list_column(count, pa.array([], type=pa.int64()))], names=names)
        _, starts, entries = book.value
        own = key[0].as_py()
        block, _, n, lo, hi = entries[int(np.searchsorted(starts, own, "right")) - 1]
        bound = np.full(len(v), np.inf)
        full = count == want
        bound[full] = dist[np.cumsum(count)[full] - 1]
        short = ~np.isfinite(bound)
        if short.any():
            bound[short] = _enough(v[short], lo, hi, n, want)
        bound = bound + 1e-9 * (1.0 + bound + np.abs(v).max(1))
        # Boxes out of reach of all these rows first, then row by row.
        reach = np.flatnonzero((_to_boxes(v.min(0)[None], v.max(0)[None], lo, hi)[0] <= bound.max()) & (block != own))
        more, others = np.zeros(len(v), dtype=np.int64), [np.zeros(0, dtype=np.int64)]
        step = max(1, 1_000_000 // max(len(reach), 1))
        for s in range(0, len(v) if len(reach) else 0, step):
            hit = _to_boxes(v[s:s + step], v[s:s + step], lo[reach], hi[reach]) <= bound[s:s + step, None]
            more[s:s + step] = hit.sum(1)
            others.append(block[reach[np.nonzero(hit)[1]]])
        return pa.table([*[asking[c] for c in ("ask", *place)], _list_column(count, pa.array(dist)), _list_column(count, near),
                         pa.array(bound), _list_column(more, pa.array(np.concatenate(others)))], names=names)

    def further(key: tuple[Any, ...], asking: pa.Table, held: pa.Table) -> pa.Table:
        bound = asking["bound"].to_numpy()
        count, dist, near = found_in(asking, held, bound)
        some = np.flatnonzero(count)
        keep = np.zeros(len(count), dtype=bool)
        keep[some] = dist[(np.cumsum(count) - count)[some]] <= bound[some]
        return pa.table([asking["ask"], _list_column(count, pa.array(dist)), _list_column(count, near)],
                        names=["ask", "far", "near"]).filter(pa.array(keep))

    def meet(left: DataFrame, work, schema: T.StructType) -> DataFrame:
        """Asking rows with the rows of their block; many asking rows are split and the block answers each part."""
        units = left.groupBy("block").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts"))
        a = left.join(units, "block").withColumn("part", F.pmod(F.xxhash64("ask"), "parts").cast("int")).drop("parts")
        # Renamed, as both sides may come from the same table.
        b = cut.select(*[F.col(c).alias(c) for c in ("block", "loc", *axes)]).join(units, "block").withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        a, b = (side.repartition(tasks, "block", "part").groupBy("block", "part") for side in (a, b))
        return a.cogroup(b).applyInArrow(work, schema)

    own = materialize(meet(asks, first, T.StructType([
        asks.schema["ask"], *[asks.schema[c] for c in place], *lists, T.StructField("bound", T.DoubleType()),
        T.StructField("more", T.ArrayType(T.LongType()))])), "first-blocks")
    left = own.select("ask", *axes, "bound", F.explode("more").alias("block"))
    hit = F.transform(F.arrays_zip("far", "near"), lambda x: F.struct(
        x["far"].alias("distance"), x["near"].alias("ref_id")))
    rest = meet(left, further, T.StructType([asks.schema["ask"], *lists])).groupBy("ask").agg(
        F.flatten(F.collect_list(hit)).alias("others"))
    found = F.when(F.col("others").isNull(), hit).otherwise(
        F.slice(F.array_sort(F.concat(hit, F.col("others"))), 1, want))
    answers = own.join(rest, "ask", "left").select("ask", *place, found.alias("found"))

    alone = same
    if len(boxes) and boxes["copies"].max() > 1:
        alone = False
        rn = F.row_number().over(Window.partitionBy(*place).orderBy("id"))
        heaps = r.join(cut.where("copies > 1").select(*place, "loc"), place)
        heaps = heaps.withColumn("_rn", rn).where(F.col("_rn") <= want)
        piles = heaps.groupBy(*place, "loc").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("cls", "loc", "ids")
        each = answers.select("ask", *place, F.explode("found").alias("hit")).select(
            "ask", *place, F.col("hit.distance").alias("distance"), F.col("hit.ref_id").alias("loc"))
        each = each.join(piles, ["cls", "loc"], "left").withColumn("ref_id", F.explode(F.coalesce("ids", F.array("loc"))))
        answers = each.groupBy("ask", *place).agg(F.slice(F.sort_array(F.collect_list(
            F.struct("distance", "ref_id"))), 1, want).alias("found"))
    if alone:
        # Every asking location is one reference.
        out = answers.join(cut.select("ask", F.col("loc").alias("id")), "ask")
    else:
        # Many queries may share a location; the skew-join rule splits such a key.
        out = q.join(materialize(answers, "answers"), place)
    found = F.col("found")
    if exclude_self:
        found = F.filter(found, lambda x: x["ref_id"] != F.col("id"))
    return out.select(F.col("id").alias("query_id"), F.posexplode(F.slice(found, 1, k)).alias("rank", "hit")).select(
        "query_id", F.col("hit.ref_id").alias("ref_id"), F.col("hit.distance").alias("distance"),
        (F.col("rank") + 1).cast("long").alias("rank"),
    )


# ---- fixed-radius neighbours ------------------------------------------------------------------

def _cell(axis: str, side) -> "F.Column":
    return F.floor(F.col(axis) / side).cast("long")


def close_pairs(locs: DataFrame, axes: list[str], radius: float, p: int = 1, unit_rows: int = 1000) -> DataFrame:
    """Ordered pairs of distinct locations within ``radius``: columns ``a_*``, ``b_*`` and ``d``.

    Grid of side ``radius``: a pair lies in adjoining grid cells. A crowded grid cell is split on both
    sides, so a join key holds about ``unit_rows`` locations of the cell and as many of each neighbour's.
    """
    side = F.lit(float(radius))
    home = [_cell(a, side).alias(f"_g{a}") for a in axes]
    gcols = [f"_g{a}" for a in axes]
    gridded = locs.select("*", *home)
    splits = gridded.groupBy(*gcols).agg(F.ceil(F.count("*") / unit_rows).cast("int").alias("_parts"))
    own = F.pmod(F.xxhash64(*axes), "_parts").cast("int")
    whole = gridded.join(splits, gcols)
    # The neighbours that look into a cell are split by their own cell's parts; the cell answers each of them.
    reached = splits.select(*gcols, "_parts")
    for g in gcols:
        reached = reached.withColumn("_o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(
            g, F.col(g) + F.col("_o")).drop("_o")
    reached = reached.groupBy(*gcols).agg(F.max("_parts").alias("_askers"))
    right = whole.join(reached, gcols).select(
        *gcols, own.alias("_part"), F.explode(F.sequence(F.lit(0), F.col("_askers") - 1)).alias("_asker"),
        *[F.col(c).alias(f"b_{c}") for c in locs.columns],
    )
    left = whole.withColumn("_asker", own).drop("_parts").select(*gcols, "_asker", *[F.col(c).alias(f"a_{c}") for c in locs.columns])
    for g in gcols:
        left = left.withColumn("_o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(
            g, F.col(g) + F.col("_o")).drop("_o")
    left = left.join(splits, gcols).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    gaps = [F.abs(F.col(f"a_{a}") - F.col(f"b_{a}")) for a in axes]
    if p == 1:
        dist = sum(gaps[1:], gaps[0])
    else:
        squares = [g * g for g in gaps]
        dist = F.sqrt(sum(squares[1:], squares[0]))
    pairs = left.join(right, [*gcols, "_part", "_asker"]).drop(*gcols, "_part", "_asker").withColumn("d", dist)
    return pairs.where((F.col("d") > 0) & (F.col("d") <= radius))


def pair_distance_quantile(points: DataFrame, axes: list[str], q: float) -> float:
    """``q``-quantile of all non-zero pairwise Manhattan distances, without forming all pairs.

    A pyramid of grid counts gives the finest grid whose same-cell pairs already outnumber the
    wanted rank; every smaller distance is found among pairs of locations that close.
    """
    locs = materialize(points.groupBy(*axes).agg(F.count("*").alias("m")), "locations")
    box = locs.agg(
        F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("same"),
        *[F.min(a).alias(f"lo_{a}") for a in axes], *[F.max(a).alias(f"hi_{a}") for a in axes],
    ).first()
    n_pairs = box["n"] * box["n"] - box["same"]
    if n_pairs <= 0:
        raise ValueError("all points share one location")
    need = math.floor(q * (n_pairs - 1)) + 2
    extent = max(box[f"hi_{a}"] - box[f"lo_{a}"] for a in axes)
    levels = 26
    level = locs.select("m", *axes, F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("lv"))
    side = F.lit(extent) / F.pow(F.lit(2.0), F.col("lv"))
    counted = level.groupBy("lv", *[F.floor((F.col(a) - F.lit(box[f"lo_{a}"])) / side).alias(f"_g{a}") for a in axes])
    counted = counted.agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("same"))
    per_level = counted.groupBy("lv").agg(F.sum(F.col("m") * F.col("m") - F.col("same")).alias("pairs")).collect()
    fine = max((row["lv"] for row in per_level if row["pairs"] >= need), default=None)
    reach = len(axes) * extent * (1 + 1e-9) / 2.0 ** fine if fine is not None else len(axes) * extent * 1.01
    pairs = close_pairs(locs, axes, reach).select(
        "d", (F.col("a_m") * F.col("b_m")).alias("w")).groupBy("d").agg(F.sum("w").alias("w"))
    got = pairs.agg(F.sum("w")).first()[0]
    return quantiles(pairs, "d", {"r": q}, weight="w", n_offset=int(n_pairs - got)).first()["r"]


def radius_neighbors(points: DataFrame, axes: list[str], radius: float) -> DataFrame:
    """``(query_id, ref_id, distance)`` with ``0 < Manhattan distance <= radius``."""
    locs = points.select(*axes).distinct()
    near = close_pairs(locs, axes, radius)
    a = points.select(F.col("id").alias("query_id"), *[F.col(x).alias(f"a_{x}") for x in axes])
    b = points.select(F.col("id").alias("ref_id"), *[F.col(x).alias(f"b_{x}") for x in axes])
    return (
        near.join(a, [f"a_{x}" for x in axes]).join(b, [f"b_{x}" for x in axes])
        .select("query_id", "ref_id", F.col("d").alias("distance"))
    )
