"""Exact removal of repeated lines and sentences across a corpus.

A text's units are its lines and the sentences of its lines. Units are normalised
(lower case, white space squeezed, outer punctuation dropped) and hashed to 128 bits. A digest's
occurrences are ranked by document id and place; the first one stays, all others are removed.
Digests are grouped globally, with minima and counts combined before the shuffle, so a line that a
third of all documents share is one row per task. What is removed is reported with offsets into the
original text, in code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuegrid.llm.common import materialize

#: Fewest words of a line, and of a sentence, that is compared at all.
LINE_WORDS, SENTENCE_WORDS = 3, 8

# Names that no table is expected to have.
_ID, _BODY, _CUT = "__cut_id", "__cut_body", "__cut_spans"

_LINE = re.compile(r"[^\n]*\n?")
_SENTENCE = re.compile(r"[^.!?]+(?:[.!?]+(?!\s)[^.!?]*)*[.!?]*\s*")
_EDGE = " .,;:!?\"'()[]{}-*#|"
_UNITS = "doc_id long, body long, a int, b int, level int, digest_a long, digest_b long"


def _normal(text: str) -> list[str]:
    return text.lower().strip(_EDGE + "\t\r\n\x0b\x0c").split()


def units(text: str, line_words: int, sentence_words: int) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, level, normalised) of each unit: level 0 a line with its line feed, 1 a sentence of a line."""
    for line in _LINE.finditer(text):
        a, b = line.span()
        if a == b:
            continue
        words = _normal(line.group())
        if len(words) >= line_words:
            yield a, b, 0, " ".join(words)
        if len(words) < sentence_words:
            continue
        for s in _SENTENCE.finditer(text, a, b):
            words = _normal(s.group())
            if len(words) >= sentence_words:
                # A line's end stays with the line.
                end = s.end() - 1 if text[s.end() - 1] == "\n" else s.end()
                yield s.start(), end, 1, " ".join(words)


def _hashed(docs: DataFrame, line_words: int, sentence_words: int) -> DataFrame:
    """One row per unit; ``body`` is a hash of the text, so that rows sharing an id stay apart."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held, count = [], 0
            for doc_id, body, text in zip(frame["doc_id"], frame["body"], frame["text"]):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                for a, b, level, normal in units(text, line_words, sentence_words):
                    held.append((doc_id, body, a, b, level, hashlib.blake2b(
                        normal.encode("utf-8", "replace"), digest_size=16).digest()))
                if len(held) > 20_000:
                    yield _frame(held)
                    held = []
            if held:
                yield _frame(held)

    return docs.where(F.length("text") > 0).select("doc_id", "body", "text").mapInPandas(run, _UNITS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    digest = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.int64).reshape(-1, 2)
    out = pd.DataFrame([r[:5] for r in rows], columns=["doc_id", "body", "a", "b", "level"])
    return out.assign(doc_id=out["doc_id"].astype("Int64"), digest_a=digest[:, 0], digest_b=digest[:, 1])


def removals(docs: DataFrame, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """(``doc_id``, ``body``, ``removed``): sorted (start, end) of the units to cut out of each text that has any.

    The kept copy of a sentence is never inside a removed line: that line's kept copy ranks earlier
    and holds the same sentence.
    """
    found = _hashed(docs, line_words, sentence_words)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body", "a", "b")
    key = ["level", "digest_a", "digest_b"]
    groups = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).where("n > 1")
    # Stored, so that the join below deals out both sides anew and splits the partitions of hot digests.
    kept = materialize(groups.select(*key, "first"), "repeated-units")
    cut = found.join(kept, key).where(rank != F.col("first"))
    return cut.groupBy("doc_id", "body").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("removed"))


def _identified(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("body", F.xxhash64("text"))


def _without(text: pd.Series, removed: pd.Series) -> pd.Series:
    out = []
    for t, spans in zip(text, removed):
        if t is None or spans is None or not len(spans):
            out.append(t)
            continue
        parts, at = [], 0
        for s in spans:
            parts.append(t[at:s["a"]])
            at = max(at, s["b"])
        out.append("".join([*parts, t[at:]]))
    return pd.Series(out, dtype=object)


def remove_repeats(docs: DataFrame, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, ``n_chars`` its new length, and ``removed`` (start, end) pairs.

    Every row is returned. Null and empty texts are unchanged (``n_chars`` null or 0, nothing
    removed). Rows equal in ``doc_id`` and ``text`` are one document and give equal rows; rows with
    one id and different texts are different documents. Null ids rank last. Columns named
    ``removed`` or ``n_chars`` are replaced, all others kept.
    """
    spans = removals(_identified(docs.select("doc_id", "text")), line_words, sentence_words)
    spans = spans.select(F.col("doc_id").alias(_ID), F.col("body").alias(_BODY), F.col("removed").alias(_CUT))
    docs = docs.drop("removed").withColumn("doc_id", F.col("doc_id").cast("long"))
    joined = docs.join(spans, (F.xxhash64("text") == F.col(_BODY)) & F.col("doc_id").eqNullSafe(F.col(_ID)), "left")
    pair = "array<struct<a:int,b:int>>"
    cleaned = joined.withColumn("text", F.pandas_udf(_without, "string")("text", _CUT)).withColumn(
        "n_chars", F.length("text").cast("long")).withColumn("removed", F.coalesce(_CUT, F.array().cast(pair)))
    return cleaned.drop(_ID, _BODY, _CUT)
