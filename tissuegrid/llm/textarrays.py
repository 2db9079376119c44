"""Vectorised word and shingle hashing over batches of texts.

A batch of texts becomes one byte buffer; words, n-grams and their 64-bit hashes are numpy arrays
over that buffer, so no Python object is made for a word. Batches are cut so that the buffers stay
within a few megabytes, whatever the batch size Spark chose; one text longer than that is a batch
of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text per numpy batch.
BATCH_BYTES = 1 << 21

_P = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def _inverse(odd: int) -> int:
    """Inverse of an odd number modulo 2**64."""
    x = odd
    for _ in range(6):
        x = (x * (2 - odd * x)) & _MASK
    return x


_P_INV = np.uint64(_inverse(int(_P)))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * _P)


def byte_table(separators: Iterable[int], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: the symbol hashed for it (A-Z folded to a-z on request) and whether it separates words."""
    code = np.arange(256)
    if fold:
        code = np.where((code >= 65) & (code <= 90), code + 32, code)
    sep = np.zeros(256, dtype=bool)
    sep[list(separators)] = True
    return _SYMBOL[code], sep


#: Words are maximal runs of bytes other than these (space, tab to carriage return).
SPACE = (0x20, *range(0x09, 0x0E))


def batches(texts: Iterable[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(position of the first text, encoded texts) with a bounded number of bytes; null is empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if held and size + len(raw) > BATCH_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


class Words:
    """Words of a batch: ``start`` and ``end`` (byte positions in ``buffer``), ``hash`` and ``doc`` (text number)."""

    def __init__(self, raw: list[bytes], table: tuple[np.ndarray, np.ndarray]):
        symbol, separator = table
        self.n_docs = len(raw)
        self.buffer = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
        lengths = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
        ends = np.cumsum(lengths)
        self.doc_start = ends - lengths
        gap = separator[self.buffer]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
        if len(edge) % 2:
            edge = np.append(edge, len(self.buffer))
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.hash = self._hash(symbol)

    def _hash(self, symbol: np.ndarray) -> np.ndarray:
        """Polynomial hash of each word from prefix sums modulo 2**64, then mixed."""
        n = len(self.buffer)
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        power = np.full(n, _P, dtype=np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbol[self.buffer] * power, out=prefix[1:])
        inverse = np.full(int(self.start[-1]) + 1, _P_INV, dtype=np.uint64)
        inverse[0] = 1
        inverse = np.cumprod(inverse)
        return mix((prefix[self.end] - prefix[self.start]) * inverse[self.start])

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text number) of every run of ``width`` words; a text with fewer words gives its whole sequence."""
        m = len(self.hash)
        if not m:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        count = np.bincount(self.doc, minlength=self.n_docs)
        whole = max(0, m - width + 1)
        value = np.zeros(whole, dtype=np.uint64)
        for j in range(width):
            value = value * _P + self.hash[j:j + whole]
        inside = self.doc[:whole] == self.doc[width - 1:] if whole else np.zeros(0, dtype=bool)
        value, owner = mix(value[inside]), self.doc[:whole][inside]
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            first = np.searchsorted(self.doc, short)
            extra = np.zeros(len(short), dtype=np.uint64)
            for j in range(width - 1):
                there = count[short] > j
                at = np.minimum(first + j, m - 1)
                extra = np.where(there, extra * _P + self.hash[at], extra)
            value = np.concatenate([value, mix(extra ^ count[short].astype(np.uint64))])
            owner = np.concatenate([owner, short])
        return value, owner

    def shingle_sets(self, width: int) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        value, owner = self.shingles(width)
        order = np.argsort(owner, kind="stable")
        value = value[order]
        cut = np.searchsorted(owner[order], np.arange(1, self.n_docs))
        return [np.unique(v) for v in np.split(value, cut)]
