"""Fill-in-the-middle rearrangement of texts, cut at tokens or characters.

Texts are handled as UTF-8 bytes. A sparse index of a text lists only its multibyte characters:
where each starts and how many bytes beyond one all characters so far take. Within ASCII a
character offset and a byte offset differ by a constant, so one binary search in that short list
converts a cut in either direction, and a pure ASCII text has an empty list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of texts that are rearranged, and of those the ones that start with the suffix.
RATE, SPM_RATE = 50, 80
SEED = 42

_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


class CharIndex:
    """Character and byte offsets of one text, kept for its multibyte characters only."""

    def __init__(self, buffer: np.ndarray):
        self.at = np.flatnonzero(buffer >= 0xC0)
        lead = buffer[self.at]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        #: Bytes in excess of one per character before each listed character, and after the last.
        self.excess = np.concatenate(([0], np.cumsum(extra)))
        self.char = self.at - self.excess[:-1]

    def to_chars(self, cuts: np.ndarray) -> np.ndarray:
        """Characters before byte offsets that lie between characters."""
        return cuts - self.excess[np.searchsorted(self.at, cuts)]

    def to_bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Byte offsets before which there are so many characters."""
        return cuts + self.excess[np.searchsorted(self.char, cuts)]


def token_ends(buffer: np.ndarray) -> np.ndarray:
    """Byte offsets after each token: a word with the white space before it, or closing white space."""
    gap = np.append(_GAP[buffer], True)
    ends = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    return np.append(ends, len(buffer)) if len(buffer) and gap[-2] else ends


def arrange(raw: bytes, form: str, cuts: np.ndarray) -> bytes:
    a, b = (int(c) for c in cuts)
    if form == "psm":
        return b"".join((PREFIX, raw[:a], SUFFIX, raw[b:], MIDDLE, raw[a:b]))
    return b"".join((SUFFIX, raw[b:], PREFIX, raw[:a], MIDDLE, raw[a:b]))


def restored(output: bytes, form: str) -> bytes:
    """The text behind an output. A text with a mark of its own is plain, so each mark is met first where it was set."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    i = output.index(second, len(first))
    j = output.index(MIDDLE, i + len(second))
    head, tail, middle = output[len(first):i], output[i + len(second):j], output[j + len(MIDDLE):]
    return head + middle + tail if form == "psm" else tail + middle + head


def draws(seed: int) -> list[Column]:
    """Four numbers below 2**32 per row from the SHA-256 of seed and ``doc_id``; null where that is null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, unit: str = "token", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED,
) -> DataFrame:
    """(``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``), one row per row of ``docs``.

    ``n`` counts the units of the whole text, tokens (words with the white space before them) or
    characters (``unit="char"``). Two draws choose where the prefix and the middle end, a third whether
    the text is rearranged, a fourth the form: ``psm`` or ``spm``. An empty or null text, one that holds
    a mark, and a row with a null id (it has no draws) stay ``plain``; lengths are null there. Rows with
    one id get the same draws, each on its own text. Other columns are ignored, whatever their names.
    """
    if unit not in ("token", "char"):
        raise ValueError(f"unknown unit {unit}")
    # Ids travel without nulls, as those would turn them into floats in a batch.
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("lost"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"),
        *(F.coalesce(h, F.lit(0)).alias(f"h{i + 1}") for i, h in enumerate(draws(seed))))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [_split(raw, h, lost, unit, rate, spm_rate) for raw, lost, h in zip(
                frame["raw"], frame["lost"], frame[["h1", "h2", "h3", "h4"]].itertuples(index=False, name=None))]
            out = pd.DataFrame(made, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield frame[["doc_id", "lost"]].join(out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"}))

    made = rows.mapInPandas(
        split, "doc_id long, lost boolean, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.select(F.when(~F.col("lost"), F.col("doc_id")).alias("doc_id"), "n", "form", "prefix_chars",
                       "middle_chars", F.col("output").cast("string").alias("output"))


def _split(raw: bytes, h: tuple, lost: bool, unit: str, rate: int, spm_rate: int) -> tuple:
    buffer = np.frombuffer(raw, dtype=np.uint8)
    index = CharIndex(buffer)
    ends = token_ends(buffer) if unit == "token" else None
    n = len(ends) if unit == "token" else int(index.to_chars(np.array([len(raw)]))[0])
    if not raw or lost or h[2] % 100 >= rate or PREFIX in raw or SUFFIX in raw or MIDDLE in raw:
        return n, "plain", None, None, raw
    units = np.sort([int(h[0]) % (n + 1), int(h[1]) % (n + 1)])
    if unit == "token":
        cuts = np.concatenate(([0], ends))[units]
        chars = index.to_chars(cuts)
    else:
        cuts, chars = index.to_bytes(units), units
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    return n, form, int(chars[0]), int(chars[1] - chars[0]), arrange(raw, form, cuts)


def restore(made: DataFrame) -> DataFrame:
    """``made`` with ``text``, the exact text rebuilt from ``output`` and ``form`` alone; null output is empty."""
    @F.pandas_udf("binary")
    def rebuild(output: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([restored(o, f) for o, f in zip(output, form)], dtype=object)

    output = F.coalesce(F.col("output"), F.lit("")).cast("binary")
    return made.withColumn("text", rebuild(output, "form").cast("string"))
