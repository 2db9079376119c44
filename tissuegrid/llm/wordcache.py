"""Whole-text token ids from the ``tokenizers`` library, encoded word by word with a bounded memory.

The library splits at white space before it merges, and its special strings hold none, so a text's
ids are the ids of its space-separated chunks in a row. Chunks repeat, so Arrow splits a column of texts
and numbers its distinct chunks; only those become Python strings, each is looked up once a column, and
encoded once while it is remembered. A new chunk of plain Latin text is lower-cased and split as the
vocabulary file says, and each part it has not seen goes to the library's merge model; any other
chunk (other scripts or white space, special strings, text that is not in composed form) goes
through the whole library. A vocabulary that is not known to split at white space gets whole texts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks, and parts of chunks, remembered per Python worker: about 60 MB for each generation.
REMEMBERED = 250_000
#: Longer chunks are encoded each time they come.
LONGEST = 48
#: Fixed value: the split pattern of the word-level vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_loaded: dict[str, "WordCache"] = {}


def cache_for(path: str) -> "WordCache":
    """The worker's cache for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = WordCache(path)
    return _loaded[path]


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def splits_at_spaces(path: str) -> bool:
    """Whether the file normalises and splits as the word-level vocabulary does, never joining across white space."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    steps = [n.get("type") for n in (told.get("normalizer") or {}).get("normalizers", [])]
    patterns = [t.get("pattern", {}).get("Regex") for t in (told.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return steps == ["NFC", "Replace", "Lowercase"] and patterns == [SPLIT, None]


class Memory:
    """Values by key, bounded: what was not asked for in the last generation is forgotten."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def values(self, keys: list[str], compute: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The value of each of the distinct ``keys``; one call computes all that are not remembered."""
        if len(self.now) > REMEMBERED:
            self.old, self.now = self.now, {}
        now, old, new = self.now, self.old, []
        found = list(map(now.get, keys))
        for i in [i for i, v in enumerate(found) if v is None]:
            k = keys[i]
            if k in old:
                found[i] = now[k] = old[k]
            else:
                new.append(i)
        for i, v in zip(new, compute([keys[i] for i in new]) if new else []):
            found[i] = v
            if len(keys[i]) <= LONGEST:
                now[keys[i]] = v
        return found


class WordCache:
    def __init__(self, path: str):
        from tissuegrid.llm.byte_bpe import byte_characters

        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.split = re.compile(_plain_split())
        self.spaced = splits_at_spaces(path)
        # The short way needs ids of two bytes.
        self.short = self.spaced and self.tokenizer.get_vocab_size() <= 1 << 16
        self.bytes = str.maketrans({i: c for i, c in enumerate(byte_characters())})
        # Each id's bytes, for the short way.
        self.packed = [i.to_bytes(4, "little") for i in range(1 << 16)] if self.short else []
        self.words, self.parts = Memory(), Memory()

    def encode(self, texts: Iterable[str | None]) -> list[list[bytes]]:
        """Per text a list of little-endian 32-bit ids; joined they are the text's ids."""
        column = pa.array([t if isinstance(t, str) else None for t in texts], type=pa.large_string())
        ids, bounds = self.encode_column(column)
        return [[ids[a:b].tobytes()] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin, closed by their number; null: empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.spaced:
            each = pa.array([self._whole(t) if t else b"" for t in texts.to_pylist()], type=pa.large_binary())
            return _ids(each, np.arange(len(each) + 1))
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        first = split.offsets.to_numpy()
        chunks = split.flatten().dictionary_encode()
        known = self.words.values(chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), self._encoded)
        ends = np.cumsum(np.fromiter(map(len, known), dtype=np.int64, count=len(known)))
        values = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(known), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(b"".join(known))])
        return _ids(values.take(chunks.indices), first - first[0])

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk; all plain ones are split by one call, line feeds standing between them."""
        plain = _plain(chunks) if self.short else []
        ids: dict[str, bytes] = {}
        if plain:
            parts = self.split.findall("\n".join(plain).lower())
            distinct = list(dict.fromkeys(parts))
            known = dict(zip(distinct, self.parts.values(distinct, self._merged)))
            pieces = b"".join(map(known.__getitem__, parts)).split(_BETWEEN)
            if len(plain) == len(chunks):
                return pieces
            ids = dict(zip(plain, pieces))
        return [ids[w] if w in ids else self._whole(w) for w in chunks]

    def _merged(self, parts: list[str]) -> list[bytes]:
        """Ids of each part by the library's merge model; printable ASCII stands for itself."""
        tokenize, packed, table = self.model.tokenize, self.packed, self.bytes
        mapped = [p if p.isascii() else p.encode().decode("latin-1").translate(table) for p in parts]
        return [_BETWEEN if m == "\n" else b"".join([packed[t.id] for t in tokenize(m)]) for m in mapped]

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


#: Stands between chunks; no ids contain it, as every id leaves its two upper bytes zero.
_BETWEEN = b"\xff\xff\xff\xff"
#: Latin letters up to U+024F without the one whose lower case depends on the rule set (U+0130).
_PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]*")


def _plain(chunks: list[str]) -> list[str]:
    """Those in printable Latin text without white space, special strings or uncomposed letters."""
    match, composed = _PLAIN.fullmatch, unicodedata.is_normalized
    return [w for w in chunks if match(w) and "<|" not in w and (w.isascii() or composed("NFC", w))]


def _plain_split() -> str:
    """``SPLIT`` and the line feed for lower-cased plain chunks, with their letters and numbers written out."""
    plain = [c for c in map(chr, range(0x250)) if _PLAIN.fullmatch(c)]
    every = sorted({*plain, *"".join(plain).lower()})
    letters, numbers = ("".join(c for c in every if unicodedata.category(c)[0] == kind) for kind in "LN")
    return SPLIT.replace(r"\p{L}", letters).replace(r"\p{N}", numbers) + r"|\n"


def _ids(chunks: pa.LargeBinaryArray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in ``chunks`` in a row, and the places where the chunks numbered ``first`` begin."""
    _, offsets, data = chunks.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[chunks.offset:chunks.offset + len(chunks) + 1] // 4
    ids = np.frombuffer(data, dtype="<u4") if data is not None else np.zeros(0, dtype="<u4")
    return ids, at[first]
