"""Best-fit-decreasing packing of token sequences into bins of one capacity.

Best-fit decreasing looks at nothing but lengths, and a length is an integer up to the capacity, so
the whole corpus enters the plan as a histogram of at most ``capacity`` counts. The plan is made on
that histogram: pieces of one length are placed together, the longest first, each run into the
tightest open bins that a segment tree over remaining capacities finds in logarithmic time. Bins
with equal remaining capacity are interchangeable, so they are kept as intervals of bin numbers.
Spark does the rest: tokens, the histogram, and each piece's number among the pieces of its length,
which a lookup in the plan turns into bin and offset. The plan's size depends on the capacity, not
on the number of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.llm.common import materialize
from tissuegrid.llm.wordcache import cache_for

CAPACITY = 2048
#: Id that closes every document.
END = 0

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class CapacityTree:
    """Segment tree over remaining capacities: which of them have open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.open = [False] * (2 * self.leaves)

    def mark(self, remaining: int, is_open: bool) -> None:
        at = self.leaves + remaining
        self.open[at] = is_open
        at //= 2
        while at:
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]
            at //= 2

    def tightest(self, need: int) -> int | None:
        """Least remaining capacity of at least ``need`` that has an open bin."""
        at = self.leaves + need
        if self.open[at]:
            return need
        # Climb until a right sibling holds an open bin, then go down its left edge.
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first piece number, pieces, first bin, offset): piece i of a run goes to bin first + i."""
    tree = CapacityTree(capacity)
    bins: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> intervals of bins (first, count)
    opened, runs = 0, []

    def keep(remaining: int, first: int, count: int) -> None:
        if count and remaining:
            bins.setdefault(remaining, []).append((first, count))
            tree.mark(remaining, True)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit a capacity of {capacity}")
        left, nth = histogram[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                fit = capacity // length
                remaining, first, count = capacity, opened, -(-left // fit)
                opened += count
            else:
                first, count = bins[remaining].pop()
                if not bins[remaining]:
                    tree.mark(remaining, False)
                fit = remaining // length
            # A bin is filled as far as it goes before the next is touched: ``full`` bins take ``fit``
            # pieces each, one more takes the rest, the others stay as they were.
            full, rest = min(count, left // fit), 0
            if full < count:
                rest = left - full * fit
            for j in range(fit if full else 0):
                runs.append((length, nth + j * full, full, first, capacity - remaining + j * length))
            keep(remaining - fit * length, first, full)
            nth += full * fit
            for j in range(rest):
                runs.append((length, nth + j, 1, first + full, capacity - remaining + j * length))
            used = full + (1 if rest else 0)
            if rest:
                keep(remaining - rest * length, first + full, 1)
            nth += rest
            left -= full * fit + rest
            keep(remaining, first + used, count - used)
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def cut_tokens(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``part`` and ``nth`` number the pieces of one length in each task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part = cache_for(path), TaskContext.get().partitionId()
        end = np.asarray([END], dtype="<u4")
        seen = [0] * (capacity + 1)
        for batch in batches:
            ids, bounds = cache.encode_column(batch.column("text"))
            rows = []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                n = b - a + 1
                for k, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    crc = zlib.crc32(ids[a + start:min(a + start + length, b)])
                    if start + length == n:
                        crc = zlib.crc32(end, crc)
                    rows.append((i, k, start, length, crc, seen[length]))
                    seen[length] += 1
            of, piece, start, length, crc, nth = np.array(rows, dtype=np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                pa.array(crc), pa.array(np.full(len(of), part, dtype=np.int32)), pa.array(nth),
            ], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, _PIECES)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each row of ``docs`` (``doc_id``, ``text``), with its place in a sequence.

    A null or empty text is its closing id alone. Repeated rows and rows with a null ``doc_id`` are
    packed like any other; other columns are ignored; an empty table gives no rows.
    """
    # Stored, so that the numbers counted in each task hold.
    cut = materialize(cut_tokens(docs, path, capacity), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    # At most one row per possible length.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan(histogram, capacity)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    shared = docs.sparkSession.sparkContext.broadcast(runs[order])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        span = 1 << 40  # more pieces than any one length has
        keys = table[:, 0] * span + table[:, 1]
        for frame in frames:
            number = (frame["first"] + frame["nth"]).to_numpy(dtype=np.int64)
            at = np.searchsorted(keys, frame["length"].to_numpy(dtype=np.int64) * span + number, side="right") - 1
            run = table[at] if len(table) else np.zeros((0, 5), dtype=np.int64)
            yield frame[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(
                sequence_id=run[:, 3] + number - run[:, 1], offset=run[:, 4])

    return cut.join(first, ["length", "part"]).mapInPandas(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
