"""Exact token counts of whole texts; huge texts are encoded in overlapping windows and spliced.

A text up to ``window`` characters is encoded as it is. A longer one is cut into windows that
overlap; every window is encoded on its own, with offsets, in whatever task it lands in. Two
neighbours are spliced at a position where both have a token starting right after white space that
both contain: the tokenizer never joins across white space, so left of it the first window's tokens
and right of it the second's are those of the whole text. Where the overlap holds no such position
the text is cut again with wider windows and overlaps, at last as one window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuegrid.llm.common import materialize
from tissuegrid.llm.wordcache import cache_for, load, splits_at_spaces

WINDOW = 1 << 15
OVERLAP = 1 << 9
#: Factor by which overlaps grow when neighbours have no common boundary.
WIDEN = 8
#: No text is longer than this many characters.
LONGEST_TEXT = (1 << 31) - 1

_COUNTS = "doc_id long, n_bytes long, n_tokens long"
_LONG = "uid string, doc_id long, n_bytes long, text string"
_WINDOWS = "uid string, doc_id long, n_bytes long, k long, start long, stop long, last boolean, piece string"
_ENCODED = ("uid string, doc_id long, n_bytes long, k long, last boolean, n long, "
            "head array<long>, head_n array<long>, tail array<long>, tail_n array<long>")


def count_tokens(docs: DataFrame, path: str, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(``doc_id``, ``n_bytes``, ``n_tokens``), one row per row of ``docs`` (``doc_id``, ``text``).

    A null or empty text counts 0 bytes and 0 tokens. Rows are counted one by one: repeated rows and
    rows with a null ``doc_id`` are returned like any other. Other columns are ignored. The splice is
    proven for vocabularies that split at white space only; with any other every text is encoded whole.
    """
    if not splits_at_spaces(path):
        window = LONGEST_TEXT
    size = F.coalesce(F.length("text"), F.lit(0))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = docs.where(size <= window).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_for(path)
        for batch in batches:
            _, bounds = cache.encode_column(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(np.diff(bounds))], ["doc_id", "n_bytes", "n_tokens"])

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at = TaskContext.get().partitionId(), 0
        for frame in frames:
            yield frame.assign(uid=[f"{part}-{at + i}" for i in range(len(frame))])
            at += len(frame)

    # Row numbers hold because the numbered rows are stored before anything reads them.
    long = materialize(docs.where(size > window).withColumn(
        "n_bytes", F.octet_length("text").cast("long")).mapInPandas(number, _LONG), "long-texts")
    parts = [short.mapInArrow(count, _COUNTS)]
    while True:
        done, open_ = _spliced(long, path, window, overlap)
        parts.append(done)
        left = materialize(long.join(open_, "uid", "left_semi"), "long-texts")
        if left.isEmpty():
            break
        long, overlap = left, overlap * WIDEN
        window = max(window, 2 * overlap)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _spliced(long: DataFrame, path: str, window: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Counts of the texts whose neighbours all met, and the ``uid`` of those that must be cut wider."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uid, doc_id, n_bytes, text in zip(frame["uid"], frame["doc_id"], frame["n_bytes"], frame["text"]):
                begins = list(range(0, max(1, len(text) - overlap), window - overlap))
                for k, a in enumerate(begins):
                    b = min(len(text), a + window)
                    yield pd.DataFrame({
                        "uid": [uid], "doc_id": pd.array([None if pd.isna(doc_id) else int(doc_id)], dtype="Int64"),
                        "n_bytes": [n_bytes], "k": [k], "start": [a], "stop": [b], "last": [k == len(begins) - 1],
                        "piece": [text[a:b]]})

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load(path)
        for frame in frames:
            rows = []
            for start, piece in zip(frame["start"], frame["piece"]):
                got = tokenizer.encode(piece, add_special_tokens=False)
                at = np.fromiter((o[0] for o in got.offsets), dtype=np.int64, count=len(got.ids))
                stable = _stable(piece, at)
                head = stable[at[stable] < overlap]
                tail = stable[at[stable] >= len(piece) - overlap]
                rows.append((len(at), at[head] + start, head, at[tail] + start, tail))
            out = frame[["uid", "doc_id", "n_bytes", "k", "last"]].copy()
            for i, name in enumerate(("n", "head", "head_n", "tail", "tail_n")):
                out[name] = [r[i] for r in rows]
            yield out

    windows = long.mapInPandas(cut, _WINDOWS)
    # Windows of one text go to many tasks.
    spread = windows.repartition(F.col("uid"), F.col("k"))
    encoded = materialize(spread.mapInPandas(encode, _ENCODED), "windows")
    left = encoded.where(~F.col("last")).select(
        "uid", "k", "n", "tail", "tail_n")
    right = encoded.where(F.col("k") > 0).select(
        "uid", (F.col("k") - 1).alias("k"), "head", "head_n")
    met = F.array_min(F.array_intersect("tail", "head"))
    at = lambda side: F.element_at(f"{side}_n", F.array_position(side, F.col("met")).cast("int"))
    pairs = left.join(right, ["uid", "k"]).withColumn("met", met).select(
        "uid", "met", (F.col("n") - F.when(F.col("met").isNotNull(), at("tail"))
                       + F.when(F.col("met").isNotNull(), at("head"))).alias("twice"))
    per_text = pairs.groupBy("uid").agg(
        F.sum("twice").alias("twice"), F.max(F.col("met").isNull()).alias("failed"))
    totals = encoded.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum("n").alias("n"))
    joined = totals.join(per_text, "uid", "left")
    failed = F.coalesce("failed", F.lit(False))
    done = joined.where(~failed).select(
        "doc_id", "n_bytes", (F.col("n") - F.coalesce("twice", F.lit(0))).alias("n_tokens"))
    return done, per_text.where("failed").select("uid")


def _stable(piece: str, at: np.ndarray) -> np.ndarray:
    """Numbers of the tokens whose start follows a plain space or line feed inside the window."""
    return np.fromiter(
        (i for i, p in enumerate(at.tolist()) if p > 0 and piece[p - 1] in " \n"), dtype=np.int64)
