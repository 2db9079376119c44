"""Near-duplicate groups: one-permutation MinHash, banded buckets, star-shaped candidate edges.

1. Every text becomes its set of word shingles. One hash of each shingle fills ``BANDS * ROWS`` bins
   (one-permutation hashing); an empty bin borrows from the first filled bin in a random order of
   its own (optimal densification). Texts with equal sets are folded into one representative.
2. Bands of ``ROWS`` bins give buckets. In a bucket every member is paired with the bucket's hub
   only, the member that shares buckets with the most texts, so a group of n texts gives n pairs.
3. Pairs whose signatures agree enough (a test that small sets are spared), and whose set sizes and
   bitmaps leave room for a link, are confirmed on full shingle sets. The bitmap test loses nothing: a bit that only one text has set
   stands for at least one shingle that the other has not.
4. A star can miss a link between two members that are both unlike the hub. Buckets that still hold
   several components are therefore compared once more across components, in blocks of bounded
   size inside tasks, first for each member's most alike partner, then, for what is still apart, for
   all of them. Only pairs that pass the tests of step 3 come out, and all are confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuegrid.llm.common import connected, materialize, release
from tissuegrid.llm.textarrays import SPACE, Words, batches, byte_table
from tissuegrid.session import spread

WIDTH = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: At a similarity of 0.75 a pair shares no bucket with probability (1 - 0.75**5)**48 = 2e-6.
BANDS, ROWS = 48, 5
#: Standard deviations below the threshold down to which signatures count as alike.
SLACK = 4.5
#: Bins of a small set are mostly borrowed and so agree or differ together: below this size only set sizes
#: and bitmaps, which lose nothing, decide whether a pair is confirmed.
SMALL = 64
#: Bits of a text's bitmap of shingles.
BITS = 2048
#: Members of a bucket per block when components are compared.
BLOCK = 1000

#: What members of a bucket are compared by.
_COMPARED = ("bands", "signature", "bitmap", "n_shingles")

_SETS = "doc_id long, n_shingles long, set_a long, set_b long, bands array<int>, signature binary, bitmap binary"
_SET_COLUMNS = ["n_shingles", "set_a", "set_b", "bands", "signature", "bitmap"]


def _least_agreement(percent: int, bins: int) -> int:
    p = percent / 100
    return max(1, int(np.floor(p * bins - SLACK * np.sqrt(bins * p * (1 - p)))))


def _bitmap(values: np.ndarray) -> bytes:
    bits = np.zeros(BITS, dtype=bool)
    bits[values & np.uint64(BITS - 1)] = True
    return np.packbits(bits).tobytes()


def _table(column, dtype: type) -> np.ndarray:
    """Rows of equally long binaries as a matrix."""
    return np.frombuffer(b"".join(column), dtype=dtype).reshape(len(column), -1)


def _room(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these bitmaps and sizes can be linked: at most ``most`` shingles are in both."""
    most = np.minimum(n_x - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64),
                      n_y - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
    return 100 * most >= percent * (n_x + n_y - most)


class Signer:
    """One-permutation signatures of sorted distinct 64-bit hashes."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.k = bands, rows, bands * rows
        width = (1 << 64) // self.k
        self.bounds = np.arange(self.k, dtype=np.uint64) * np.uint64(width)
        rng = np.random.Generator(np.random.PCG64(7))
        # For each bin an order of all bins in which it looks for a filled one.
        self.order = np.argsort(rng.random((self.k, self.k)), axis=1)
        self.salt = rng.integers(1, 1 << 62, size=self.rows, dtype=np.uint64) | np.uint64(1)

    def bins(self, values: np.ndarray) -> np.ndarray:
        at = np.searchsorted(values, self.bounds)
        end = np.append(at[1:], len(values))
        filled = at < end
        least = np.where(filled, values[np.minimum(at, len(values) - 1)], np.uint64(0))
        empty = np.flatnonzero(~filled)
        if len(empty):
            order = self.order[empty]
            least[empty] = least[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
        return least

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, bytes]:
        least = self.bins(values)
        band = (least.reshape(self.bands, self.rows) * self.salt).sum(axis=1)
        band ^= band >> np.uint64(32)
        return band.astype(np.uint32).view(np.int32), (least & np.uint64(255)).astype(np.uint8).tobytes()


def shingle_sets(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Set size, 128-bit set digest, band hashes, signature and bitmap of each text (null for empty sets)."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        signer, table = Signer(bands, rows), byte_table(SPACE, fold=True)
        for frame in frames:
            for first, raw in batches(frame["text"]):
                out = []
                for values in Words(raw, table).shingle_sets(width):
                    if not len(values):
                        out.append((0, None, None, None, None, None))
                        continue
                    digest = np.frombuffer(hashlib.blake2b(values.tobytes(), digest_size=16).digest(), dtype=np.int64)
                    out.append((len(values), int(digest[0]), int(digest[1]), *signer(values), _bitmap(values)))
                ids = frame["doc_id"].iloc[first:first + len(raw)]
                got = pd.DataFrame(out, columns=_SET_COLUMNS, index=ids.index)
                got["set_a"], got["set_b"] = got["set_a"].astype("Int64"), got["set_b"].astype("Int64")
                got.insert(0, "doc_id", ids)
                yield got

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(sign, _SETS)


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """(``doc_id``, ``n_shingles``, ``component_id``, ``kept``), one row per row of ``docs``.

    Words are runs of characters other than space and control white space, A-Z lower-cased. A text
    with fewer than ``width`` words is one shingle; a text without words, or null, has an empty set
    and is linked with nothing. Rows with the same ``doc_id`` are one document: they share a
    component, each reports its own set. A row with a null ``doc_id`` is linked with nothing and has
    a null component; it is kept. Other columns are ignored.
    """
    sets = materialize(shingle_sets(docs, width, bands, rows), "sets")
    full = sets.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # The digest's minimum is combined before the shuffle: a set that many texts have stays small.
    reps = materialize(full.groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("node"), F.min_by(F.struct(*_COMPARED), "doc_id").alias("s"))
        .select("set_a", "set_b", "node", "s.*"), "representatives")
    links = _links(docs, full, reps, width, percent, bands * rows, block)
    component = materialize(links, "components")
    group = reps.select("set_a", "set_b", "node").join(component, "node", "left").select(
        "set_a", "set_b", F.coalesce("component", "node").alias("component"))
    group = materialize(group, "groups")
    out = sets.select("doc_id", "n_shingles", "set_a", "set_b").join(group, ["set_a", "set_b"], "left")
    # Rows without a set, or without an id, stand alone.
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component_id = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


def _links(
    docs: DataFrame, full: DataFrame, reps: DataFrame, width: int, percent: int, bins: int, block: int,
) -> DataFrame:
    """(``node``, ``component``) over representatives that have a link."""
    bins_needed = _least_agreement(percent, bins)
    exploded = reps.select("node", F.posexplode("bands").alias("band", "value")).select(
        "node", "band", F.xxhash64("band", "value").alias("bucket"))
    counts = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = materialize(exploded.join(materialize(counts, "buckets"), "bucket"), "members")
    # Ids that stand in rows with different sets tie those sets together.
    twins = (full.groupBy("doc_id").agg(F.min("set_a").alias("x"), F.max("set_a").alias("y")).where("x <> y")
             .select("doc_id").join(full.select("doc_id", "set_a", "set_b"), "doc_id")
             .join(reps.select("set_a", "set_b", "node"), ["set_a", "set_b"])
             .select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    found = [twins]
    busy = shared.select("node").distinct()
    signatures = materialize(reps.select("node", *_COMPARED).join(busy, "node", "left_semi"), "signatures")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(busy, "node", "left_semi")
    members = materialize(_sets_of(texts, width), "shingles")

    degree = shared.groupBy("node").agg(F.sum("members").alias("degree"))
    ranked = shared.join(materialize(degree, "degrees"), "node")
    hubs = ranked.groupBy("bucket").agg(
        F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("top")).select(
        "bucket", (-F.col("top.minus")).alias("hub"))
    star = shared.join(materialize(hubs, "hubs"), "bucket").where("node <> hub").select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    alike = _agreeing(star, signatures, bins_needed, percent)
    found.append(materialize(_confirmed(alike, members, percent), "links"))
    component = materialize(connected(_union(found)), "components")

    for best_only in (True, False):
        pairs = materialize(_across(shared, signatures, component, bins_needed, percent, block, best_only), "pairs")
        if pairs.isEmpty():
            break
        more = materialize(_confirmed(pairs, members, percent), "links")
        if not more.isEmpty():
            found.append(more)
            # Components found so far stand for all earlier links.
            held = component.select(F.col("node").alias("a"), F.col("component").alias("b"))
            component = materialize(connected(held.unionByName(more)), "components")
        release(pairs)
    return component


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _sets_of(texts: DataFrame, width: int) -> DataFrame:
    """(``node``, ``shingles``) of the texts that are in some pair."""

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = byte_table(SPACE, fold=True)
        for frame in frames:
            for first, raw in batches(frame["text"]):
                got = Words(raw, table).shingle_sets(width)
                yield pd.DataFrame({"node": frame["node"].iloc[first:first + len(raw)].to_numpy(),
                                    "shingles": [v.view(np.int64) for v in got]})

    return texts.mapInPandas(sets, "node long, shingles array<long>")


def _agreeing(pairs: DataFrame, signatures: DataFrame, least: int, percent: int) -> DataFrame:
    """Pairs whose signatures agree in at least ``least`` bins, or one of which is small, and whose sets can be linked."""

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            agree = (_table(frame["x"], np.uint8) == _table(frame["y"], np.uint8)).sum(axis=1)
            n, m = frame["n"].to_numpy(), frame["m"].to_numpy()
            room = _room(_table(frame["p"], np.uint64), _table(frame["q"], np.uint64), n, m, percent)
            yield frame.loc[((agree >= least) | (np.minimum(n, m) < SMALL)) & room, ["a", "b"]]

    side = lambda node, x, p, n: signatures.select(
        F.col("node").alias(node), F.col("signature").alias(x), F.col("bitmap").alias(p), F.col("n_shingles").alias(n))
    left, right = side("a", "x", "p", "n"), side("b", "y", "q", "m")
    return pairs.join(left, "a").join(right, "b").mapInPandas(keep, "a long, b long")


def _confirmed(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are alike enough."""
    left = members.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = members.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - both
    near = pairs.join(left, "a").join(right, "b").where(100 * both >= percent * union)
    return near.select("a", "b").distinct()


def _across(
    shared: DataFrame, signatures: DataFrame, component: DataFrame, least: int, percent: int, block: int,
    best_only: bool,
) -> DataFrame:
    """Agreeing pairs between components that meet in a bucket.

    A bucket's largest component is compared with the members of the others, and these among each
    other. Both sides are cut into parts of about ``block`` members; a group of the shuffle is one
    part of the smaller side with one part of either, so its size is bounded whatever the bucket holds.
    """
    placed = shared.select("bucket", "band", "node").join(component, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    placed = materialize(placed, "placed")
    per = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("components"), F.sum("n").alias("total"),
        F.max(F.struct("n", (-F.col("component")).alias("minus"))).alias("top")).where("components > 1").select(
        "bucket", "total", F.col("top.n").alias("largest"), (-F.col("top.minus")).alias("main"))
    members = placed.join(materialize(main, "mixed"), "bucket").join(signatures, "node")
    parts = lambda n: F.ceil(n / F.lit(float(block))).cast("int")
    members = members.withColumn("minor", F.col("component") != F.col("main")).withColumn(
        "small", parts(F.col("total") - F.col("largest"))).withColumn("large", parts(F.col("largest")))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("small")).otherwise(F.col("large"))).cast("int")
    members = members.withColumn("part", mine)
    # Parts of the largest component are numbered after those of the others.
    to_small = lambda q: F.struct(F.least(q, F.col("part")).alias("i"), F.greatest(q, F.col("part")).alias("j"))
    to_large = lambda p: F.struct(F.col("part").alias("i"), (F.col("small") + p).alias("j"))
    from_large = lambda q: F.struct(q.alias("i"), (F.col("small") + F.col("part")).alias("j"))
    each = lambda n: F.sequence(F.lit(0), n - 1)
    cells = F.when(F.col("minor"), F.concat(
        F.transform(each(F.col("small")), to_small), F.transform(each(F.col("large")), to_large)
    )).otherwise(F.transform(each(F.col("small")), from_large))
    members = members.select("bucket", F.explode(cells).alias("cell"), "band", "node", "component", "minor", *_COMPARED)
    # Comparing costs far more than moving these rows: an explicit number of tasks spreads it.
    dealt = spread(members, "bucket", "cell").sortWithinPartitions("bucket", "cell")
    dealt = dealt.select("bucket", "cell.*", "band", "node", "component", "minor", *_COMPARED)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _runs(frames, ["bucket", "i", "j"]):
            found = _alike(group, least, percent, best_only)
            if len(found):
                yield found

    return dealt.mapInPandas(compare, "a long, b long").distinct()


def _runs(frames: Iterator[pd.DataFrame], key: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Column arrays of each run of equal keys, which may span frames."""
    held = None
    for frame in frames:
        if held is not None:
            frame = pd.concat([held, frame], ignore_index=True)
        keys = frame[key].to_numpy()
        cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
        columns = {c: frame[c].to_numpy() for c in ("band", "node", "component", "minor", *_COMPARED)}
        for a, b in zip(cut[:-1], cut[1:]):
            yield {c: v[a:b] for c, v in columns.items()}
        held = frame.iloc[cut[-1]:]
    if held is not None and len(held):
        yield {c: held[c].to_numpy() for c in ("band", "node", "component", "minor", *_COMPARED)}


def _alike(group: dict[str, np.ndarray], least: int, percent: int, best_only: bool) -> pd.DataFrame:
    """Pairs across components with enough equal bins and room for a link; a pair comes only from the first band it shares.

    Bands are told equal by the hashes that made the buckets, not by the signature's short codes: only
    then has the pair met in the earlier bucket.
    """
    y, bits, n = _table(group["signature"], np.uint8), _table(group["bitmap"], np.uint64), group["n_shingles"]
    node, owner, band = group["node"], group["component"], group["band"][0]
    before = np.stack(group["bands"])[:, :band]
    a, b = [], []
    for i in np.flatnonzero(group["minor"]):
        agree = (y == y[i]).sum(axis=1)
        near = np.flatnonzero(((agree >= least) | (np.minimum(n, n[i]) < SMALL)) & (owner != owner[i]))
        if len(near) and band:
            near = near[~(before[near] == before[i]).any(axis=1)]
        near = near[_room(bits[near], bits[i], n[near], n[i], percent)]
        if best_only and len(near):
            near = near[np.argmax(agree[near]):][:1]
        a += [node[i]] * len(near)
        b += node[near].tolist()
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}, dtype=np.int64).drop_duplicates()
