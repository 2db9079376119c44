"""Ranked lexical search with the roles reversed: the few items are indexed, the many documents stream past.

The items' terms form an inverted index (term -> items with weights) small enough to broadcast. Each
document is cut into terms once; the counts of those the index knows are kept as a compact table, from
which document frequencies and lengths are summed. A second pass leads every document's counts through
the index and keeps, per task and item, the best few documents; those short lists are merged.

More items than one broadcast may hold are searched in blocks, each with its own index. An item that
is too long for any block is joined on its terms instead.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tissuegrid.llm.common import materialize, release
from tissuegrid.llm.textarrays import BATCH_BYTES, Words, byte_table

BEST = 20
#: Bytes of one broadcast index: its terms and 24 for each pair of term and item.
INDEX_BYTES = 1 << 25
#: Score cells (documents x items) and index entries that are worked on at once.
CELLS, ENTRIES = 1 << 21, 1 << 21
#: Terms are runs of other bytes: ASCII letters and digits, and all of multibyte characters.
BREAKS = (*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))

_BREAK = re.compile(b"[" + re.escape(bytes(BREAKS)) + b"]")
_TABLE = byte_table(BREAKS, fold=True)
FOUND = "item_id long, doc_id long, score long"


def rank(docs: DataFrame, items: DataFrame, best: int = BEST, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(``item_id``, ``rank``, ``doc_id``, ``score``): each item's ``best`` documents with a score above 0.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; other columns are ignored.
    Weights and scores are those of BM25 in whole numbers (k1 = 1.2, b = 0.25). A null or empty text has
    no terms; an item without terms, or without any document that shares one, gives no rows, nor does
    an empty table. Rows of one ``item_id`` (null included) are one item whose terms add up. Each row of
    ``docs`` is a document of its own, also where ids repeat; a null ``doc_id`` comes after all others of
    its score. Long texts are read in pieces that end between terms.
    """
    terms = materialize(_item_terms(items), "item-terms")
    cost = F.length("term") + F.lit(24)
    sizes = materialize(terms.groupBy("item_id").agg(F.sum(cost).alias("bytes")), "item-sizes")
    # An eighth of a block at most, so that a few blocks more always get below the bound.
    long = F.col("bytes") > index_bytes // 8
    small = sizes.where(~long)
    found = [_search(docs, terms, block, best) for block in _blocks(small, index_bytes)]
    if not sizes.where(long).isEmpty():
        found.append(_joined(docs, terms.join(sizes.where(long).withColumnRenamed("item_id", "id"),
                                              F.col("item_id").eqNullSafe(F.col("id"))).drop("id", "bytes"), best))
    out = found[0] if found else docs.sparkSession.createDataFrame([], FOUND)
    for more in found[1:]:
        out = out.unionByName(more)
    return _ranked(out, best)


def _ranked(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select(
        "item_id", "rank", "doc_id", "score")


def _blocks(small: DataFrame, index_bytes: int) -> list[DataFrame]:
    """Items dealt by hash into as few blocks as keep every one below the bound."""
    total = small.agg(F.sum("bytes")).first()[0] or 0
    if not total:
        return []
    if total <= index_bytes:
        return [small.select("item_id")]
    n = max(2, -(-2 * total // index_bytes))
    while True:
        dealt = small.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)))
        if dealt.groupBy("block").agg(F.sum("bytes").alias("b")).where(F.col("b") > index_bytes).isEmpty():
            break
        n *= 2
    return [dealt.where(F.col("block") == i).select("item_id") for i in range(n)]


# Terms of texts ------------------------------------------------------------------------------


def _pieces(raw: bytes) -> Iterator[bytes]:
    """The text in pieces that end between terms, each about a batch at most."""
    start = 0
    while len(raw) - start > BATCH_BYTES:
        cut = _BREAK.search(raw, start + BATCH_BYTES)
        if cut is None:
            break
        yield raw[start:cut.start()]
        start = cut.start()
    yield raw[start:] if start else raw


def _batches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, Words]]:
    """(text number of each piece, words of the pieces) in bounded batches."""
    owner, held, size = [], [], 0
    for i, raw in enumerate(texts):
        for piece in _pieces(raw):
            if held and size + len(piece) > BATCH_BYTES:
                yield np.array(owner), Words(held, _TABLE)
                owner, held, size = [], [], 0
            owner.append(i)
            held.append(piece)
            size += len(piece) + 1
    if held:
        yield np.array(owner), Words(held, _TABLE)


def _text(df: DataFrame, key: str, *more: str) -> DataFrame:
    """Texts as bytes; keys travel without nulls, as those would turn them into floats in a batch."""
    number = F.coalesce(F.col(key).cast("long"), F.lit(0)).alias(key)
    return df.select(number, F.col(key).isNull().alias("lost"), *more, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))


def _item_terms(items: DataFrame) -> DataFrame:
    """(``item_id``, ``term``, ``n``): how often an item holds a term."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for owner, words in _batches(list(frame["raw"])):
                if len(words.start):
                    memory = words.buffer.tobytes()
                    part = pd.DataFrame({"at": owner[words.doc], "term": [
                        memory[a:b].lower() for a, b in zip(words.start, words.end)]})
                    counts = part.groupby(["at", "term"], sort=False).size().reset_index(name="n")
                    named = frame[["item_id", "lost"]].iloc[counts["at"]].reset_index(drop=True)
                    yield named.join(counts[["term", "n"]])

    parts = _text(items, "item_id").mapInPandas(cut, "item_id long, lost boolean, term binary, n long")
    return parts.groupBy(F.when(~F.col("lost"), F.col("item_id")).alias("item_id"), "term").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Terms with their hashes in order; a word of a text counts only if its bytes equal the term's."""

    def __init__(self, terms: list[bytes]):
        words = Words(terms, _TABLE)
        order = np.argsort(words.hash, kind="stable")
        self.hash = words.hash[order]
        if len(self.hash) != len(terms) or len(np.unique(self.hash)) != len(terms):
            raise ValueError("terms with equal hashes")
        self.terms = [terms[i] for i in order]
        length = np.array([len(t) for t in self.terms], dtype=np.int64)
        self.end = np.cumsum(length)
        self.start = self.end - length
        self.bytes = np.frombuffer(b"".join(self.terms), dtype=np.uint8)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word number, term number) of the words that are terms."""
        at = np.minimum(np.searchsorted(self.hash, words.hash), len(self.hash) - 1)
        size = words.end - words.start
        hit = np.flatnonzero((self.hash[at] == words.hash) & (size == (self.end - self.start)[at]))
        if not len(hit):
            return hit, hit
        at, size = at[hit], size[hit]
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        seen = words.buffer[np.repeat(words.start[hit], size) + step]
        seen = np.where((seen >= 65) & (seen <= 90), seen + 32, seen)
        same = np.logical_and.reduceat(seen == self.bytes[np.repeat(self.start[at], size) + step], first)
        return hit[same], at[same]


def _term_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """(``doc_id``, ``lost``, ``n``, ``terms``, ``counts``) of documents with terms: how many, and those of the vocabulary."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary.value
        width = len(known.terms)
        for frame in frames:
            if not len(frame):
                continue
            total = np.zeros(len(frame), dtype=np.int64)
            keys, tallies = [], []
            for owner, words in _batches(list(frame["raw"])):
                total += np.bincount(owner[words.doc], minlength=len(frame)) if len(words.doc) else 0
                word, term = known.find(words)
                key, tally = np.unique(owner[words.doc[word]] * width + term, return_counts=True)
                keys.append(key)
                tallies.append(tally)
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            tally = np.zeros(len(key), dtype=np.int64)
            np.add.at(tally, back, np.concatenate(tallies))
            cut = np.searchsorted(key, np.arange(1, len(frame)) * width)
            term = np.split((key % width).astype(np.int32), cut)
            tally = np.split(tally, cut)
            out = frame[["doc_id", "lost"]].assign(
                n=total, terms=[t.tobytes() for t in term], counts=[t.tobytes() for t in tally])
            yield out[total > 0]

    return _text(docs, "doc_id").mapInPandas(
        count, "doc_id long, lost boolean, n long, terms binary, counts binary")


# Search by index -----------------------------------------------------------------------------


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _search(docs: DataFrame, terms: DataFrame, block: DataFrame, best: int) -> DataFrame:
    """The best documents of each task for each item of the block."""
    spark = docs.sparkSession
    own = block.withColumnRenamed("item_id", "id")
    index = terms.join(own, F.col("item_id").eqNullSafe(F.col("id"))).select("item_id", "term", "n").toArrow()
    if not index.num_rows:
        return spark.createDataFrame([], FOUND)
    ids, texts, repeats = (index[c].to_pylist() for c in ("item_id", "term", "n"))
    names = list(dict.fromkeys(ids))
    known = Vocabulary(list(dict.fromkeys(texts)))
    term_at, item_at = ({v: i for i, v in enumerate(values)} for values in (known.terms, names))
    term, item = np.array([term_at[t] for t in texts]), np.array([item_at[i] for i in ids])
    order = np.lexsort((item, term))
    first = np.searchsorted(term[order], np.arange(len(known.terms) + 1))
    counted = materialize(_term_counts(docs, spark.sparkContext.broadcast(known)), "term-counts")
    n_docs, length = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return spark.createDataFrame([], FOUND)
    width = len(known.terms)

    def holders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(width, dtype=np.int64)
        for frame in frames:
            df += np.bincount(np.frombuffer(b"".join(frame["terms"]), dtype=np.int32), minlength=width)
        some = np.flatnonzero(df)
        yield pd.DataFrame({"term": some, "df": df[some]})

    df = counted.select("terms").mapInPandas(holders, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = np.zeros(width, dtype=np.int64)
    for row in df.collect():
        weight[row.term] = _weight(n_docs, row.df)
    shared = spark.sparkContext.broadcast(
        (first, item[order], (weight[term] * np.array(repeats))[order], names))

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, item, gain, names = shared.value
        heaps = Heaps(len(names), best)
        for frame in frames:
            for lo in range(0, len(frame), step := max(1, CELLS // len(names))):
                part = frame.iloc[lo:lo + step]
                score = _scores(part, first, item, gain, len(names), n_docs, length)
                heaps.offer(score, part["doc_id"].to_numpy(), part["lost"].to_numpy())
        yield from heaps.rows(names)

    return counted.mapInPandas(stream, FOUND)


def _scores(
    part: pd.DataFrame, first: np.ndarray, item: np.ndarray, gain: np.ndarray, n_items: int, n_docs: int, length: int,
) -> np.ndarray:
    """Scores of every document of the batch with every item, in 64-bit whole numbers."""
    m = np.array([75 + 25 * int(n) * n_docs // length for n in part["n"]], dtype=np.int64)
    held = np.array([len(t) // 4 for t in part["terms"]])
    term = np.frombuffer(b"".join(part["terms"]), dtype=np.int32)
    tf = np.frombuffer(b"".join(part["counts"]), dtype=np.int64)
    doc = np.repeat(np.arange(len(part)), held)
    share = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
    score = np.zeros(len(part) * n_items, dtype=np.int64)
    fan = first[term + 1] - first[term]
    # Runs of terms whose index entries together stay within the bound.
    reach = np.cumsum(fan)
    lo = 0
    while lo < len(term):
        hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + ENTRIES, side="right")))
        f = fan[lo:hi]
        entry = np.arange(int(f.sum())) - np.repeat(np.cumsum(f) - f - first[term[lo:hi]], f)
        cell = np.repeat(doc[lo:hi] * n_items, f) + item[entry]
        np.add.at(score, cell, np.repeat(share[lo:hi], f) * gain[entry])
        lo = hi
    return score.reshape(len(part), n_items)


class Heaps:
    """The best few (score, document) per item; equal scores keep the smaller id, a missing id comes last."""

    def __init__(self, n_items: int, best: int):
        self.best = best
        self.item = np.zeros(0, dtype=np.int64)
        self.score, self.doc = self.item, self.item
        self.lost = np.zeros(0, dtype=bool)
        self.floor = np.zeros(n_items, dtype=np.int64)

    def offer(self, score: np.ndarray, ids: np.ndarray, lost: np.ndarray) -> None:
        doc, item = np.nonzero((score > 0) & (score >= self.floor))
        if not len(doc):
            return
        value = np.concatenate([self.score, score[doc, item]])
        item = np.concatenate([self.item, item])
        number = np.concatenate([self.doc, ids[doc]])
        lost = np.concatenate([self.lost, lost[doc]])
        order = np.lexsort((number, lost, -value, item))
        item, value, number, lost = item[order], value[order], number[order], lost[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.best
        full = place == self.best - 1
        self.floor[item[full]] = value[full]
        self.item, self.score, self.doc, self.lost = item[keep], value[keep], number[keep], lost[keep]

    def rows(self, names: list) -> Iterator[pd.DataFrame]:
        if len(self.item):
            yield pd.DataFrame({
                "item_id": pd.Series([names[i] for i in self.item], dtype=object),
                "doc_id": pd.Series([None if x else d for d, x in zip(self.doc.tolist(), self.lost)], dtype=object),
                "score": self.score})


# Search by join ------------------------------------------------------------------------------


def _joined(docs: DataFrame, terms: DataFrame, best: int) -> DataFrame:
    """The same ranking for items too long to broadcast: documents' terms are joined with theirs."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(len(frame)):
                tally: dict[bytes, int] = {}
                for _, words in _batches([frame["raw"].iat[at]]):
                    memory = words.buffer.tobytes()
                    for a, b in zip(words.start, words.end):
                        t = memory[a:b].lower()
                        tally[t] = tally.get(t, 0) + 1
                if tally:
                    yield pd.DataFrame({
                        **frame[["uid", "doc_id", "lost"]].iloc[at], "n": sum(tally.values()), "term": list(tally),
                        "tf": list(tally.values())})

    numbered = materialize(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("uid")), "numbered")
    counted = materialize(_text(numbered, "doc_id", "uid").mapInPandas(
        cut, "uid long, doc_id long, lost boolean, n long, term binary, tf long"), "all-terms")
    release(numbered)
    n_docs, length = counted.groupBy("uid").agg(F.first("n").alias("n")).agg(F.count(F.lit(1)), F.sum("n")).first()
    wanted = terms.select("term").distinct()
    df = counted.join(wanted, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = terms.join(df, "term").withColumn(
        "gain", F.col("n") * F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1)))).drop("n")
    m = F.expr(f"75 + ((25 * n * {n_docs}L) div {length or 1}L)")
    share = F.expr("(1000000000L * tf) div (1000 * tf + 12 * m)")
    scored = counted.withColumn("m", m).withColumn("share", share).join(weighed, "term").groupBy(
        "item_id", "uid", F.when(~F.col("lost"), F.col("doc_id")).alias("doc_id")).agg(
        F.sum(F.col("share") * F.col("gain")).alias("score"))
    return scored.where("score > 0").select("item_id", "doc_id", "score")
