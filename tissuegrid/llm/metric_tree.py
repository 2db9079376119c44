"""Exact nearest-by-inner-product search in a forest of M-trees.

Vectors of whole numbers get one more coordinate that makes all their lengths equal; among them the
greatest inner product with a query is the least Euclidean distance, and distances obey the triangle
inequality. The vectors are dealt to pivots, crowded pivots to several trees by hash, and one task
builds an M-tree of each bounded group: pages of entries with a routing vector, its covering radius
and its distance to the routing vector of the page above.

A query first searches the tree it lies in. The tables of tree centres and radii then tell which
other trees could still hold something at least as good; blocks of queries meet those trees. Inside
a tree pages are taken best first, each with the queries of the block that still need it, and an
entry whose stored distances already rule it out is passed over without computing anything on its
vector. Bounds leave room for rounding and scores are whole
numbers, so the result is exact whatever the pivots.

Equal vectors are folded with their smallest ids, so a vector that a third of all rows hold is one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.llm.common import limit_batches, materialize, release
from tissuegrid.operators.ranking import row_numbers

BEST, SCALE, EVERY = 5, 256, 50
#: Vectors per tree, on average at most; entries of a leaf page, and of the pages above.
TREE, LEAF, FAN = 8192, 64, 16
#: Pivots are a sample by hash of at most so many vectors and bytes per vector length.
MAX_PIVOTS, PIVOT_BYTES = 1024, 1 << 24
#: Queries that travel together, and bytes of tree centres that are broadcast at once.
BLOCK, CENTRE_BYTES = 2048, 1 << 25
#: Vectors above this squared length have scores that no 64-bit number holds.
MAX_SQUARE = float(2 ** 62)


def top_k(
    vectors: DataFrame, best: int = BEST, every: int = EVERY, scale: int = SCALE, tree: int = TREE,
) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): for each query the ``best`` rows by inner product.

    ``vectors`` has ``vec_id`` and ``embedding``; components count as floor(scale * x). Queries are the
    rows whose id is divisible by ``every``, candidates all rows of another id; equal scores rank the
    smaller id first. A row takes no part if its id or vector is null, a component is null or not
    finite, or its squared length in whole numbers reaches 2**62, as its scores would not fit 64 bits.
    Only vectors of one length are compared; empty ones score 0. Repeated rows count once; an id with
    several vectors stands with its best pair. Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = materialize(_whole(vectors, scale), "vectors")
    asking = rows.where(F.col("vec_id") % every == 0)
    folded = materialize(_folded(rows, asking, best + 1), "folded")
    placed = materialize(_placed(folded, tree), "placed")
    forest = materialize(_forest(placed, tree), "forest")
    release(placed)
    # A row holds a whole tree here, so few of them may be in a batch.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        home = materialize(_at_home(forest, best + 1), "home")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK))
        visits = materialize(_visits(forest, home, best + 1), "visits")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        away = materialize(_abroad(forest, visits, best + 1), "away")
    finally:
        limit_batches(spark)
    key = ["tree", "at"]
    found = home.select(*key, F.explode(F.arrays_zip("ids", "scores")).alias("f")).select(
        *key, F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))
    found = found.unionByName(away).groupBy(*key, "vec_id").agg(F.max("score").alias("score"))
    found = materialize(_first(found, key, best + 1), "found")
    asked = asking.select(F.col("vec_id").alias("query_id"), "v").distinct().join(home.select("v", *key), "v")
    pairs = asked.join(found, key).where(F.col("vec_id") != F.col("query_id"))
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _first(pairs, ["query_id"], best).select("query_id", "rank", "vec_id", "score")


def _first(found: DataFrame, key: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _whole(vectors: DataFrame, scale: int) -> DataFrame:
    """Distinct (``vec_id``, ``v``) of the rows that take part, ``v`` in whole numbers."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (
        F.abs(c.cast("double")) * scale < 2.0 ** 31))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select("vec_id", x.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda t, c: t + c.cast("double") * c)
    return rows.where(square < MAX_SQUARE).distinct()


def _folded(rows: DataFrame, asking: DataFrame, n: int) -> DataFrame:
    """(``v``, ``size``, ``ids``, ``asks``): each vector once, with its ``n`` smallest ids."""
    order = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("i", F.row_number().over(order)).where(F.col("i") <= n)
    kept = kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = asking.select("v").distinct().withColumn("asks", F.lit(True))
    return kept.join(asked, "v", "left").select("v", F.size("v").alias("size"), "ids", F.coalesce("asks", F.lit(False)).alias("asks"))


# Geometry ------------------------------------------------------------------------------------


class Space:
    """Vectors of one length with the coordinate that evens their norms; ``top`` is the greatest squared norm."""

    def __init__(self, top: int):
        self.top = top
        self.exact = top < 2 ** 51
        self.slack = 1e-6 + 1e-7 * float(np.sqrt(top))

    def load(self, x: np.ndarray) -> np.ndarray:
        """Whole numbers in the type whose products are exact: doubles where sums stay below 2**53."""
        return x.astype(np.float64) if self.exact else x

    def last(self, x: np.ndarray) -> np.ndarray:
        square = np.einsum("ij,ij->i", x, x).astype(np.float64)
        return np.sqrt(np.maximum(0.0, self.top - square))

    def between(self, x: np.ndarray, x_last: np.ndarray, y: np.ndarray, y_last: float) -> np.ndarray:
        """Distances of the vectors ``x`` to one vector ``y``; all have the squared length ``top``."""
        product = (x @ y).astype(np.float64) + x_last * y_last
        return np.sqrt(np.maximum(0.0, 2.0 * self.top - 2.0 * product))

    def to_query(self, products: np.ndarray, square: float) -> np.ndarray:
        """Distances to a query, whose own last coordinate is 0, from the inner products with it."""
        return np.sqrt(np.maximum(0.0, float(self.top) + square - 2.0 * np.asarray(products, dtype=np.float64)))


def _matrix(column: pd.Series, size: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), size)


def _unpacked(raw: bytes, size: int) -> np.ndarray:
    flat = np.frombuffer(raw, dtype=np.int64)
    return flat.reshape(-1, size) if size else flat.reshape(1, 0)


# Dealing vectors to trees --------------------------------------------------------------------


def _placed(folded: DataFrame, tree: int) -> DataFrame:
    """``folded`` with ``tree``, the number of a group of about ``tree`` vectors at most, and ``top`` of its length."""
    spark = folded.sparkSession
    square = F.aggregate("v", F.lit(0).cast("long"), lambda t, c: t + c * c)
    sizes = {r["size"]: r for r in folded.groupBy("size").agg(
        F.count(F.lit(1)).alias("n"), F.max(square).alias("top")).collect()}
    wanted = {s: max(1, min(MAX_PIVOTS, PIVOT_BYTES // (8 * s + 8), -(-2 * r["n"] // tree))) for s, r in sizes.items()}
    order = Window.partitionBy("size").orderBy(F.xxhash64("v"), "v")
    table = spark.createDataFrame(list(wanted.items()), "size int, wanted long")
    sample = folded.select("size", "v").withColumn("i", F.row_number().over(order)).where(
        F.col("i") <= MAX_PIVOTS).join(F.broadcast(table), "size").where(F.col("i") <= F.col("wanted")).collect()
    pivots = {s: _matrix(pd.Series([r["v"] for r in sample if r["size"] == s]), s) for s in sizes}
    number = {s: at for at, s in enumerate(sorted(sizes))}
    shared = spark.sparkContext.broadcast({s: (pivots[s], int(sizes[s]["top"]), number[s] * MAX_PIVOTS) for s in sizes})

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, part in frame.groupby("size"):
                pivot, top, base = shared.value[size]
                space = Space(top)
                p, x = space.load(pivot), space.load(_matrix(part["v"], size))
                product = (x @ p.T).astype(np.float64) + np.outer(space.last(x), space.last(p))
                yield part.assign(pivot=base + product.argmax(axis=1), top=top)

    near = materialize(folded.mapInPandas(
        nearest, "v array<long>, size int, ids array<long>, asks boolean, pivot long, top long"), "pivots")
    # One row per pivot, of which there are few by their bound.
    parts = near.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / tree).cast("long").alias("parts"))
    group = F.pmod(F.xxhash64("v", F.lit(7)), F.col("parts"))
    return near.join(F.broadcast(parts), "pivot").select(
        "v", "size", "ids", "asks", "top", F.shiftleft("pivot", 32).bitwiseOR(group).alias("tree"))


def _forest(placed: DataFrame, tree: int) -> DataFrame:
    """One row per tree: its vectors and ids, its pages, and centre and radius of the whole."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        size, top = int(frame["size"].iat[0]), int(frame["top"].iat[0])
        whole = _matrix(frame["v"], size)
        pages = Pages(whole, Space(top))
        ids = np.concatenate([np.asarray(i, dtype=np.int64) for i in frame["ids"]])
        return pd.DataFrame({
            "tree": [frame["tree"].iat[0]], "size": [size], "top": [top], "n": [len(frame)], "vectors": [whole.tobytes()],
            "ids": [ids.tobytes()], "copies": [np.array([len(i) for i in frame["ids"]], dtype=np.int64).tobytes()],
            "asks": [frame["asks"].to_numpy(dtype=bool).tobytes()], "centre": [whole[pages.root].tobytes()],
            "radius": [pages.radius_all], **{name: [value] for name, value in pages.stored().items()}})

    schema = ("tree long, size int, top long, n int, vectors binary, ids binary, copies binary, asks binary, centre binary, "
              "radius double, root int, first binary, object binary, child binary, radii binary, above binary")
    return placed.groupBy("tree").applyInPandas(build, schema)


class Pages:
    """Pages of an M-tree over one group of vectors, page 0 at the top.

    Entry ``e`` of a page names a vector (``object``), the page below it (``child``, -1 in a leaf), the
    radius that covers everything there, and its distance to the routing vector of the page (``above``).
    """

    def __init__(self, whole: np.ndarray, space: Space):
        self.x, self.space = space.load(whole), space
        self.last = space.last(self.x)
        self.root = 0
        self.pages: list[list[tuple[int, int, float, float]]] = []
        everything = np.arange(len(whole))
        distance = self._distance(everything, 0)
        self.radius_all = float(distance.max())
        todo = [(everything, distance, self._page())]
        while todo:
            members, distance, page = todo.pop()
            if len(members) <= LEAF:
                self.pages[page] = [(int(m), -1, 0.0, float(d)) for m, d in zip(members, distance)]
                continue
            for routing, part, near in self._parts(members):
                below = self._page()
                at = float(distance[np.searchsorted(members, routing)])
                self.pages[page].append((routing, below, float(near.max()), at))
                todo.append((part, near, below))

    def _page(self) -> int:
        self.pages.append([])
        return len(self.pages) - 1

    def _distance(self, members: np.ndarray, to: int) -> np.ndarray:
        return self.space.between(self.x[members], self.last[members], self.x[to], self.last[to])

    def _parts(self, members: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Members dealt to the nearest of some of them, in ascending order within each part."""
        chosen = members[np.linspace(0, len(members) - 1, FAN).astype(int)]
        distance = np.stack([self._distance(members, c) for c in chosen])
        nearest = distance.argmin(axis=0)
        if (nearest == nearest[0]).all():  # too close together for doubles to tell: cut evenly
            nearest = np.arange(len(members)) * FAN // len(members)
        out = []
        for i in range(FAN):
            mine = nearest == i
            if mine.any():
                part = members[mine]
                routing = int(chosen[i]) if chosen[i] in part else int(part[0])
                out.append((routing, part, distance[i][mine] if routing == chosen[i] else self._distance(part, routing)))
        return out

    def stored(self) -> dict[str, bytes | int]:
        flat = [e for page in self.pages for e in page]
        column = lambda i, kind: np.array([e[i] for e in flat], dtype=kind).tobytes()
        first = np.cumsum([0, *(len(p) for p in self.pages)]).astype(np.int64)
        return {"root": self.root, "first": first.tobytes(), "object": column(0, np.int64), "child": column(1, np.int64),
                "radii": column(2, np.float64), "above": column(3, np.float64)}


# Search --------------------------------------------------------------------------------------


class Tree:
    """A stored tree, opened in a task."""

    def __init__(self, row):
        self.space = Space(int(row.top))
        self.whole = np.frombuffer(row.vectors, dtype=np.int64).reshape(row.n, row.size)
        self.x = self.space.load(self.whole)
        copies = np.frombuffer(row.copies, dtype=np.int64)
        ids = np.frombuffer(row.ids, dtype=np.int64).tolist()
        ends = np.cumsum(copies).tolist()
        self.ids = [ids[e - c:e] for e, c in zip(ends, copies.tolist())]
        self.first = np.frombuffer(row.first, dtype=np.int64).tolist()
        self.object, self.child = (np.frombuffer(row[c], dtype=np.int64) for c in (12, 13))
        self.radii, self.above = (np.frombuffer(row[c], dtype=np.float64) for c in (14, 15))
        self.root, self.radius = row.root, row.radius
        self.computed = 0

    def search(self, queries: np.ndarray, bests: list[Best]) -> None:
        """Offer to each query's ``Best`` every vector that could rank in it.

        Pages wait in one queue, nearest to any query first, each with the queries it is still near enough
        to; so a page meets all its queries in one product.
        """
        q = self.space.load(queries)
        square = np.einsum("ij,ij->i", q, q).astype(np.float64)
        slack = self.space.slack + 1e-7 * np.sqrt(square)
        floor = np.array([b.floor for b in bests], dtype=np.float64)
        limit = self._limits(floor, square, slack)
        up = self.space.to_query(q @ self.x[self.root], square)
        bound = np.maximum(0.0, up - self.radius)
        queue = [(float(bound.min()), 0, np.arange(len(q)), bound, up)]
        while queue and queue[0][0] <= limit.max():
            _, page, who, bound, up = heapq.heappop(queue)
            near = bound <= limit[who]
            who, bound, up = who[near], bound[near], up[near]
            a, b = self.first[page], self.first[page + 1]
            # The triangle inequality over stored distances, before any product.
            open_ = np.abs(up[:, None] - self.above[a:b]) - self.radii[a:b] <= limit[who][:, None]
            some = np.flatnonzero(open_.any(axis=0))
            if not len(some):
                continue
            open_, at = open_[:, some], self.object[some + a]
            product = q[who] @ self.x[at].T
            self.computed += product.size
            if self.child[a] < 0:
                open_ &= product >= floor[who][:, None]
                for i in np.flatnonzero(open_.any(axis=1)).tolist():
                    best, good = bests[who[i]], np.flatnonzero(open_[i])
                    for j in good[np.argsort(-product[i, good], kind="stable")].tolist():
                        if not best.offer(int(product[i, j]), self.ids[at[j]]):
                            break
                    floor[who[i]] = best.floor
                limit = self._limits(floor, square, slack)
            else:
                distance = self.space.to_query(product, square[who][:, None])
                least = np.maximum(distance - self.radii[some + a], bound[:, None])
                open_ &= least <= limit[who][:, None]
                for j, child in enumerate(self.child[some + a].tolist()):
                    mine = np.flatnonzero(open_[:, j])
                    if len(mine):
                        heapq.heappush(queue, (float(least[mine, j].min()), child, who[mine], least[mine, j], distance[mine, j]))

    def _limits(self, floor: np.ndarray, square: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Farthest a vector may lie from each query and still rank."""
        far = self.space.to_query(np.where(np.isfinite(floor), floor, 0.0), square)
        return np.where(np.isfinite(floor), far + slack, np.inf)


class Best:
    """The ``n`` best ids with their scores; equal scores keep the smaller id."""

    def __init__(self, n: int, floor: int | None = None):
        self.n, self.held = n, {}
        self.floor = -np.inf if floor is None else floor

    def offer(self, score: int, ids: list[int]) -> bool:
        """Take the ids that rank; False where the score is below all that does."""
        if score < self.floor:
            return False
        for i in ids:
            if self.held.get(i, score - 1) < score:
                self.held[i] = score
        if len(self.held) > self.n:
            self.held = dict(sorted(self.held.items(), key=lambda e: (-e[1], e[0]))[:self.n])
        if len(self.held) == self.n:
            self.floor = max(self.floor, min(self.held.values()))
        return True


def _at_home(forest: DataFrame, n: int) -> DataFrame:
    """(``tree``, ``at``, ``v``, ``ids``, ``scores``): each asking vector with the best of its own tree."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                tree = Tree(row)
                asking = np.flatnonzero(np.frombuffer(row.asks, dtype=bool))
                for lo in range(0, len(asking), BLOCK):
                    at = asking[lo:lo + BLOCK]
                    bests = [Best(n) for _ in at]
                    tree.search(tree.whole[at], bests)
                    yield pd.DataFrame({
                        "tree": row.tree, "at": at, "size": row.size, "top": row.top, "v": tree.whole[at].tolist(),
                        "ids": [list(b.held) for b in bests], "scores": [list(b.held.values()) for b in bests]})

    return forest.select(*_STORED).mapInPandas(
        search, "tree long, at int, size int, top long, v array<long>, ids array<long>, scores array<long>")


_STORED = ["tree", "size", "top", "n", "vectors", "ids", "copies", "asks", "centre", "radius", "root", "first",
           "object", "child", "radii", "above"]


def _visits(forest: DataFrame, home: DataFrame, n: int) -> DataFrame:
    """Blocks of queries for each tree that is not their own and could improve their results."""
    centres = materialize(row_numbers(forest.select("tree", "size", "centre", "radius"), [F.col("tree")]), "centres")
    total = centres.agg(F.count(F.lit(1)), F.max("size")).first()
    share = max(1, CENTRE_BYTES // (8 * (total[1] or 0) + 64))
    empty = centres.sparkSession.createDataFrame([], _VISIT)
    # Tree centres are broadcast a bounded part at a time.
    for part in range(-(-total[0] // share)):
        some = centres.where(F.floor((F.col("rn") - 1) / share) == part).collect()
        empty = empty.unionByName(_visits_of(home, some, n))
    return empty


_VISIT = "goal long, home binary, at binary, queries binary, floors binary, width int"


def _visits_of(home: DataFrame, centres: list, n: int) -> DataFrame:
    by_size: dict[int, list] = {}
    for c in centres:
        by_size.setdefault(c["size"], []).append(c)
    shared = home.sparkSession.sparkContext.broadcast({
        s: (np.array([c["tree"] for c in cs]), np.array([c["radius"] for c in cs]), np.concatenate(
            [_unpacked(bytes(c["centre"]), s) for c in cs])) for s, cs in by_size.items()})

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, part in frame.groupby("size"):
                if size not in shared.value:
                    continue
                trees, radius, centre = shared.value[size]
                space = Space(int(part["top"].iat[0]))
                whole = _matrix(part["v"], size)
                x, c = space.load(whole), space.load(centre)
                square = np.einsum("ij,ij->i", x, x).astype(np.float64)[:, None]
                floors = np.array([min(s) for s in part["scores"]], dtype=np.int64)
                # Too few found so far: any tree may help.
                full = part["scores"].map(len).to_numpy() == n
                limit = np.where(full, space.to_query(floors, square[:, 0]), np.inf)
                reach = np.maximum(0.0, space.to_query(x @ c.T, square) - radius)
                slack = 2 * (space.slack + 1e-7 * np.sqrt(square))
                wanted = (reach <= limit[:, None] + slack) & (part["tree"].to_numpy()[:, None] != trees)
                for t in np.flatnonzero(wanted.any(axis=0)):
                    mine = wanted[:, t]
                    floor = np.where(full, floors, np.iinfo(np.int64).min)[mine]
                    yield pd.DataFrame({
                        "goal": [trees[t]], "home": [part["tree"].to_numpy()[mine].tobytes()],
                        "at": [part["at"].to_numpy(dtype=np.int64)[mine].tobytes()], "queries": [whole[mine].tobytes()],
                        "floors": [floor.tobytes()], "width": [int(mine.sum())]})

    return home.mapInPandas(choose, _VISIT)


def _abroad(forest: DataFrame, visits: DataFrame, n: int) -> DataFrame:
    """(``tree``, ``at``, ``vec_id``, ``score``) that the visited trees add for each asking vector."""
    pairs = visits.join(forest.select(*_STORED), visits["goal"] == forest["tree"]).select(
        *_STORED, "home", "at", "queries", "floors", "width")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                tree = Tree(row)
                queries = np.frombuffer(row.queries, dtype=np.int64).reshape(row.width, row.size)
                keys = [np.frombuffer(b, dtype=np.int64).tolist() for b in (row.home, row.at, row.floors)]
                bests = [Best(n, None if f == np.iinfo(np.int64).min else f) for f in keys[2]]
                tree.search(queries, bests)
                out = [(home, at, i, s) for best, home, at in zip(bests, *keys[:2]) for i, s in best.held.items()]
                if out:
                    yield pd.DataFrame(out, columns=["tree", "at", "vec_id", "score"])

    return pairs.mapInPandas(search, "tree long, at int, vec_id long, score long")
