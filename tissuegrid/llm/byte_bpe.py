"""Byte-level BPE through a sentencepiece model written straight from a rank file.

The model file is serialised here: one piece per rank, its bytes mapped to printable characters,
its score the negative rank, so that sentencepiece's merges pick the lowest rank first; identity
normalisation, no added prefix, no white-space rules. Texts are cut into pre-tokens by a pattern,
each distinct pre-token is encoded once per worker while it is remembered, and ids are decoded by
the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens remembered per Python worker.
REMEMBERED = 250_000
LONGEST = 48

_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def byte_characters() -> str:
    """256 distinct characters, one per byte: printable Latin-1 stands for itself, the rest lies from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    chars = {b: chr(b) for b in plain}
    return "".join(chars[b] if b in chars else chr(next(spare)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _message(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece follows the last rank.

    Ranks must be 0 to n - 1. Field numbers are those of the public model format.
    """
    table = str.maketrans({i: c for i, c in enumerate(byte_characters())})
    ordered = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks have gaps")
    out = bytearray()
    for token in ordered:
        piece = token.decode("latin-1").translate(table).encode()
        out += _message(1, _message(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(ranks[token])))
    out += _message(1, _message(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(ordered) + 1) + _number(40, len(ordered)) + b"".join(
        _number(field, -1) for field in (41, 42, 43))  # no begin, end or padding piece
    normaliser = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return bytes(out) + _message(2, trainer) + _message(3, normaliser)


class ByteBpe:
    """Encode and decode with a serialised model; one per worker and rank file."""

    _loaded: dict[tuple[str, str], "ByteBpe"] = {}

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.pieces = regex.compile(pattern)
        self.table = str.maketrans({i: c for i, c in enumerate(byte_characters())})
        self.inverse = sorted(self.ranks, key=self.ranks.get)
        self.known: dict[str, bytes] = {}

    @classmethod
    def get(cls, path: str, pattern: str) -> "ByteBpe":
        if (path, pattern) not in cls._loaded:
            cls._loaded[path, pattern] = cls(path, pattern)
        return cls._loaded[path, pattern]

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a text; null is empty. Lone surrogates become U+FFFD first."""
        if not text:
            return b""
        found = self.pieces.findall(text)
        known = self.known
        new = [p for p in set(found) if p not in known]
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set(found))
            raw = [p.encode("utf-8", "replace") for p in new]
            # A pre-token that is a token by itself needs no merges.
            rest = [i for i, r in enumerate(raw) if r not in self.ranks]
            got = self.model.encode([raw[i].decode("latin-1").translate(self.table) for i in rest], num_threads=1)
            ids = dict(zip(rest, got))
            fresh = {p: np.asarray(ids[i] if i in ids else [self.ranks[raw[i]]], dtype="<u4").tobytes()
                     for i, p in enumerate(new)}
            long = {p: v for p, v in fresh.items() if len(p) > LONGEST}
            known.update((p, v) for p, v in fresh.items() if len(p) <= LONGEST)
            if long:
                return b"".join([long[p] if p in long else known[p] for p in found])
        return b"".join([known[p] for p in found])

    def decode(self, ids: bytes) -> bytes:
        inverse = self.inverse
        return b"".join([inverse[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes, one row per row of ``docs``.

    A null or empty text has no ids. Repeated rows and null ids are treated like any other row;
    other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = ByteBpe.get(path, pattern)
        for frame in frames:
            rows = []
            for text in frame["text"]:
                ids = bpe.encode(text)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=frame.index)
            out.insert(0, "doc_id", frame["doc_id"])
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, _OUT)
