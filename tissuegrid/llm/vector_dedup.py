"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are projected on the leading principal directions of the table; a grid whose cells are
as wide as the greatest distance of a linked pair orders them lexicographically. The ordered
sequence is cut into intervals of bounded size, and those into strips, as many as keep the cores busy
but no larger than a task can hold. A task holds one strip and lets intervals of about half of the other
strips pass by, so that a vector travels once for every second strip, not once for every interval; an
interval whose box in the leading dimensions stays farther from a strip's than that distance is not sent.
Inside a task small blocks that are provably apart are skipped and matrix products settle the others. The
projection never lengthens a distance, so no pair is lost whatever the directions; they only decide how
much is skipped.

Equal vectors are folded first and counted, so a vector that a third of all rows hold is one row. Equality
is that of two hashes, 128 bits, so that vectors need not travel to be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tissuegrid.llm.common import connected, limit_batches, materialize, release

COSINE = 0.93
#: Leading principal directions that order and prune.
LEADING = 6
#: Vectors per interval, and per block that is compared outright.
INTERVAL, LEAF = 512, 64
#: Least vectors of a strip, where there are so many, and most bytes that a task holds of it as doubles.
STRIP_ROWS, STRIP_BYTES = 8192, 64 << 20
#: Columns of a matrix product, and links that are kept before they are united.
COLUMNS, KEPT_LINKS = 2048, 1 << 20


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, leading: int = LEADING, interval: int = INTERVAL, leaf: int = LEAF,
    strip: int | None = None,
) -> DataFrame:
    """(``vec_id``, ``n_links``, ``component_id``, ``kept``), one row per row of ``vectors``.

    ``vectors`` has ``vec_id``, ``embedding`` (array of numbers) and ``label``. Two rows are linked when
    their labels are equal and not null, their vectors have one length and their cosine in double
    precision is at least ``cosine``. A null, empty or zero vector, or one with a null or non-finite
    component, links with nothing, as does a row with a null id (its component is null, it is kept).
    Rows with the same id are one vector for the counts when they are equal, and share a component
    in any case. Other columns are ignored. ``strip`` sets the vectors of a strip.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    number = lambda x: x.cast("double")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")))
    some = F.exists("embedding", lambda x: number(x) != 0)
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & some, F.lit(False))
    # Rows that link with nothing match no key.
    first, second = F.xxhash64("label", "embedding"), F.xxhash64(F.size("embedding"), "embedding", "label")
    rows = rows.select(
        "vec_id", "label", "embedding", valid.alias("valid"), first.alias("k1"), F.when(valid, second).alias("k2"))
    keys = ["k1", "k2"]
    ids = materialize(rows.where("valid").select("vec_id", *keys).distinct(), "ids")
    groups = materialize(ids.groupBy(*keys).agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "groups")
    folded = rows.where("valid").groupBy(*keys).agg(F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"))
    folded = materialize(folded.join(groups, keys).select("label", "embedding", "node", "copies"), "vectors")
    axes = folded.sparkSession.sparkContext.broadcast(directions(folded, leading))
    # Components travel as they are stored, unless doubles are needed for them.
    held_as = np.float32 if isinstance(folded.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    blocks = materialize(_intervals(folded, axes, held_as, cosine, interval), "intervals")
    release(folded)
    met = _met(blocks, axes, held_as, cosine, leaf, strip)
    release(blocks)
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    # An id with several vectors ties them together.
    edges = met.select(F.col("node").alias("a"), F.col("root").alias("b"))
    members = materialize(ids.join(groups, keys).select("vec_id", "node"), "members")
    twins = members.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    twins = members.join(twins.select("vec_id"), "vec_id").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    component = connected(edges.unionByName(twins))
    per_node = materialize(groups.join(links, "node", "left").join(component, "node", "left").select(
        *keys, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
        F.coalesce("component", "node").alias("component")), "linked")
    out = rows.select("vec_id", *keys).join(per_node, keys, "left")
    component_id = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                      component_id.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component_id, F.lit(True)).alias("kept"))


def _reach(cosine: float) -> float:
    """Distance of unit vectors at that cosine, with room for rounding."""
    return float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9


def _stack(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(folded: DataFrame, leading: int) -> dict[int, np.ndarray]:
    """Per vector length the leading principal directions (length x up to ``leading``)."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for size, part in frame.groupby(frame["embedding"].map(len)):
                x = np.hstack([np.ones((len(part), 1)), _unit(_stack(part["embedding"]))])
                total[size] = total.get(size, 0) + x.T @ x
        for size, s in total.items():
            i, j = np.triu_indices(size + 1)
            yield pd.DataFrame({"size": size, "i": i, "j": j, "s": s[i, j]})

    # One row per pair of dimensions reaches the driver.
    got = folded.select("embedding").mapInPandas(sums, "size int, i int, j int, s double").groupBy(
        "size", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = {}
    for size, part in got.groupby("size"):
        s = np.zeros((size + 1, size + 1))
        s[part["i"], part["j"]] = part["s"]
        n, mean = s[0, 0], s[0, 1:] / s[0, 0]
        upper = s[1:, 1:]
        covariance = (upper + upper.T - np.diag(np.diag(upper))) / n - np.outer(mean, mean)
        out[int(size)] = np.linalg.eigh(covariance)[1][:, ::-1][:, :leading]
    return out


def _intervals(folded: DataFrame, axes: Broadcast, held_as: type, cosine: float, interval: int) -> DataFrame:
    """Packed runs of the grid-ordered sequence: vectors, ids and the box of their projections."""
    label = folded.schema["label"].dataType
    reach = _reach(cosine)

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, part in frame.groupby(frame["embedding"].map(len)):
                p = _unit(_stack(part["embedding"])) @ axes.value[size]
                yield part[["label", "node", "copies"]].assign(
                    size=size, cell=list(np.floor(p / reach).astype(np.int32)),
                    vector=[np.asarray(v, dtype=held_as).tobytes() for v in part["embedding"]])

    flat = T.StructType([
        T.StructField("label", label), T.StructField("node", T.LongType()), T.StructField("copies", T.LongType()),
        T.StructField("size", T.IntegerType()), T.StructField("cell", T.ArrayType(T.IntegerType())),
        T.StructField("vector", T.BinaryType())])
    order = ["label", "size", "cell", "node"]
    # The id in the order lets a single crowded cell span many partitions.
    ordered = folded.mapInPandas(project, flat).repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at, held = TaskContext.get().partitionId(), 0, []

        def block() -> pd.DataFrame:
            nonlocal at
            size, vectors = held[0][3], b"".join(h[5] for h in held)
            p = _unpacked(size, vectors, held_as) @ axes.value[size]
            at += 1
            return pd.DataFrame({
                "block": [(part << 32) + at], "label": [held[0][0]], "size": [size], "rows": [len(held)],
                "low": [p.min(axis=0)], "high": [p.max(axis=0)],
                "node": [np.array([h[1] for h in held], dtype=np.int64).tobytes()],
                "copies": [np.array([h[2] for h in held], dtype=np.int64).tobytes()], "vectors": [vectors]})

        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                if held and (len(held) == interval or row[0] != held[0][0] or row[3] != held[0][3]):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    packed = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("label", label), T.StructField("size", T.IntegerType()),
        T.StructField("rows", T.LongType()),
        T.StructField("low", T.ArrayType(T.DoubleType())), T.StructField("high", T.ArrayType(T.DoubleType())),
        *(T.StructField(n, T.BinaryType()) for n in ("node", "copies", "vectors"))])
    return ordered.mapInPandas(pack, packed)


def _unpacked(size: int, vectors: bytes, held_as: type) -> np.ndarray:
    return _unit(np.frombuffer(vectors, dtype=held_as).reshape(-1, size).astype(np.float64))


def _strips(blocks: DataFrame, leading: int, strip: int | None) -> tuple[DataFrame, DataFrame]:
    """Intervals with their strip, and one row (``unit``) per strip with its box; nothing of the vectors."""
    boxes = blocks.select("block", "label", "size", "rows", "low", "high")
    if strip is None:
        total = boxes.agg(F.sum("rows")).first()[0] or 0
        share = max(STRIP_ROWS, total // blocks.sparkSession.sparkContext.defaultParallelism)
        strip = F.greatest(F.lit(1), F.least(F.lit(share), F.floor(F.lit(STRIP_BYTES) / (8 * F.col("size")))))
    # One row per interval, hundreds of times fewer than vectors.
    before = F.sum("rows").over(Window.partitionBy("label", "size").orderBy("block")) - F.col("rows")
    boxes = materialize(boxes.withColumn("strip", F.floor(before / strip)).drop("rows"), "boxes")
    side = lambda f, c: F.array(*(f(F.get(c, F.lit(i))) for i in range(leading))).alias(c)
    units = boxes.groupBy("label", "size", "strip").agg(side(F.min, "low"), side(F.max, "high"))
    # A strip is named by its place among those that have intervals.
    place = Window.partitionBy("label", "size")
    units = units.withColumn("place", F.row_number().over(place.orderBy("strip")) - 1).withColumn("all", F.count(F.lit(1)).over(place))
    units = materialize(units.withColumn("unit", F.monotonically_increasing_id()), "strips")
    return boxes.join(F.broadcast(units.select("label", "size", "strip", "place")), ["label", "size", "strip"]), units


def _met(
    blocks: DataFrame, axes: Broadcast, held_as: type, cosine: float, leaf: int, strip: int | None,
) -> DataFrame:
    """(``node``, ``links``, ``root``) for each task in which the node has a link."""
    spark = blocks.sparkSession
    reach = _reach(cosine)
    boxes, units = _strips(blocks, max((a.shape[1] for a in axes.value.values()), default=1), strip)
    gap = F.aggregate(
        F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("low_t", "high_t"), lambda a, b: F.greatest(
            a["low"] - b["high_t"], b["low_t"] - a["high"], F.lit(0.0))),
        F.lit(0.0), lambda t, g: t + g * g)
    holders = units.select("label", "size", "all", "unit", *(F.col(c).alias(f"{c}_t") for c in ("place", "low", "high")))
    # Every two strips of a label meet once, and every strip holds while about half of the others pass.
    ahead = F.pmod(F.col("place") - F.col("place_t"), F.col("all"))
    meets = (2 * ahead < F.col("all")) | ((2 * ahead == F.col("all")) & (F.col("place_t") < F.col("place")))
    pairs = boxes.join(F.broadcast(holders), ["label", "size"]).where(
        (ahead == 0) | (meets & (gap <= reach * reach))).select("block", "unit", (ahead != 0).alias("passing"))
    pairs = materialize(pairs, "pairs")
    # More partitions than strips, so that few of them share one.
    dealt = blocks.select("block", "size", "node", "copies", "vectors").join(pairs, "block").repartition(
        max(1, 4 * units.count()), "unit").sortWithinPartitions("unit", "passing", "block")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, own, strip = None, [], None
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.unit != unit:
                    if own:
                        yield (strip or _Strip(own, cosine, reach, leaf)).linked()
                    unit, own, strip = row.unit, [], None
                x = _unpacked(row.size, row.vectors, held_as)
                part = (x @ axes.value[row.size], x, *(np.frombuffer(v, dtype=np.int64) for v in (row.node, row.copies)))
                if not row.passing:
                    own.append(part)
                    continue
                strip = strip or _Strip(own, cosine, reach, leaf)
                yield strip.meet(*part)
        if own:
            yield (strip or _Strip(own, cosine, reach, leaf)).linked()

    # Few intervals travel in one Arrow batch, as each holds hundreds of vectors.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        return materialize(dealt.mapInPandas(compare, "node long, links long, root long"), "compared")
    finally:
        limit_batches(spark)


class _Strip:
    """Vectors that a task holds, with the links found so far: counts, and a position of the same component for each."""

    def __init__(self, blocks: list, cosine: float, reach: float, leaf: int):
        p, self.x, self.node, self.copies = (np.concatenate(v) for v in zip(*blocks))
        self.cosine, self.reach, self.leaf = cosine, reach, leaf
        starts = np.arange(0, len(p), leaf)
        self.low, self.high = np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)
        self.links = np.zeros(len(p), dtype=np.int64)
        self.root = np.arange(len(p))
        self.ties: list[tuple[np.ndarray, np.ndarray]] = []
        self.tied = 0
        for s in starts:
            rows = slice(s, s + leaf)
            for i, j in self._hits(p[rows], self.x[rows], s):
                i += s
                once = i < j
                i, j = i[once], j[once]
                self._count(self.links, i, self.copies[j])
                self._count(self.links, j, self.copies[i])
                self._tie(i, j)

    def meet(self, p: np.ndarray, x: np.ndarray, node: np.ndarray, copies: np.ndarray) -> pd.DataFrame:
        """Rows of an interval that passes by; those of the strip are counted."""
        links, one = np.zeros(len(node), dtype=np.int64), np.full(len(node), -1)
        for s in range(0, len(node), self.leaf):
            rows = slice(s, s + self.leaf)
            for i, j in self._hits(p[rows], x[rows], 0):
                i += s
                self._count(links, i, self.copies[j])
                self._count(self.links, j, copies[i])
                one[i] = np.where(one[i] < 0, j, one[i])
                self._tie(one[i], j)
        found = links > 0
        return pd.DataFrame({"node": node[found], "links": links[found], "root": self.node[one[found]]})

    def linked(self) -> pd.DataFrame:
        self._unite()
        found = self.links > 0
        return pd.DataFrame({"node": self.node[found], "links": self.links[found], "root": self.node[self.root[found]]})

    def _hits(self, p: np.ndarray, x: np.ndarray, start: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of ``x`` and, from ``start`` on, of the strip that reach the cosine."""
        leaf, first = self.leaf, start // self.leaf
        apart = np.maximum(0, np.maximum(self.low[first:] - p.max(axis=0), p.min(axis=0) - self.high[first:]))
        near = np.flatnonzero((apart * apart).sum(axis=1) <= self.reach * self.reach) + first
        step = max(1, COLUMNS // leaf)
        for k in range(0, len(near), step):
            part = near[k:k + step]
            begin, end = part[0] * leaf, min((part[-1] + 1) * leaf, len(self.node))
            # Leaves between that are apart hold no link, so they may be compared, too.
            together = end - begin <= 2 * leaf * len(part)
            at = slice(begin, end) if together else (part[:, None] * leaf + np.arange(leaf)).ravel()
            if not together and at[-1] >= end:
                at = at[at < end]
            hits = np.flatnonzero(x @ self.x[at].T >= self.cosine)
            if len(hits):
                i, j = np.divmod(hits, end - begin if together else len(at))
                yield i, j + begin if together else at[j]

    @staticmethod
    def _count(links: np.ndarray, at: np.ndarray, copies: np.ndarray) -> None:
        if len(at):
            low = at.min()
            sums = np.bincount(at - low, copies).astype(np.int64)
            links[low:low + len(sums)] += sums

    def _tie(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.root[a] != self.root[b]
        if apart.any():
            self.ties.append((a[apart], b[apart]))
            self.tied += int(apart.sum())
            if self.tied > KEPT_LINKS:
                self._unite()

    def _unite(self) -> None:
        """Every position gets the least root that the kept links lead to."""
        if not self.ties:
            return
        a, b = (np.concatenate(v) for v in zip(*self.ties))
        self.ties, self.tied = [], 0
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up
