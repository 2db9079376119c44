"""License scans: winnowed fingerprints pick candidate templates, banded alignment reports coverage.

Templates are short public license notices; each becomes a word sequence. From every window of
``WINDOW`` consecutive word k-grams the least hash is kept (winnowing), so that any shared run of
``GRAM + WINDOW - 1`` words shares a kept hash. The templates' hashes form an inverted index from hash
to (template, position), bounded by the templates and sent to every task. A text's kept hashes hit
the index; hits on nearby diagonals open a band, and inside the band a local alignment of the two
word sequences (matches, substitutions, gaps) gives the matched words of the template, hence its
coverage, and the characters the match spans in the text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuegrid.llm.textarrays import Words, batches, byte_table

GRAM, WINDOW = 3, 2
#: Half-width of the alignment band, in words.
BAND = 8
#: Least share of a template's words that a match must cover.
COVERAGE = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1

#: Public license notices, as their texts ask to be quoted.
TEMPLATES: dict[str, str] = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."),
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "mit-short": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution."),
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0.",
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."),
}

_TABLE = byte_table([b for b in range(128) if not chr(b).isalnum()], fold=True)
_OUT = ("doc_id long, template string, coverage double, matched_words int, template_words int, "
        "start long, stop long")


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Sorted positions of the least hash of each window of grams, the last of equals; a short run keeps its least."""
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))], dtype=np.int64) if len(grams) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(axis=1))


def _grams(words: np.ndarray, size: int = GRAM) -> np.ndarray:
    if len(words) < size:
        return np.zeros(0, dtype=np.uint64)
    value = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for j in range(size):
        value = value * np.uint64(0x9E3779B97F4A7C15) + words[j:j + len(value)]
    return value ^ (value >> np.uint64(29))


class Index:
    """Word hashes of the templates and the inverted index of their winnowed grams."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = list(templates)
        words = Words([templates[n].encode() for n in self.names], _TABLE)
        cut = np.searchsorted(words.doc, np.arange(1, len(self.names)))
        self.words = np.split(words.hash, cut)
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, w in enumerate(self.words):
            grams = _grams(w)
            for p in winnow(grams).tolist():
                self.places[int(grams[p])].append((t, p))
        self.keys = np.array(sorted(self.places), dtype=np.uint64)

    def candidates(self, grams: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Per template the (position in the text, position in the template) of shared kept grams."""
        kept = winnow(grams)
        if not len(kept) or not len(self.keys):
            return {}
        at = np.minimum(np.searchsorted(self.keys, grams[kept]), len(self.keys) - 1)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p in kept[self.keys[at] == grams[kept]].tolist():
            for t, q in self.places[int(grams[p])]:
                hits[t].append((p, q))
        return hits


def regions(hits: list[tuple[int, int]], length: int, band: int = BAND) -> list[tuple[int, int, int]]:
    """(first text word, last text word, diagonal) of each group of hits whose diagonals lie within the band."""
    out: list[list[int]] = []
    for p, q in sorted(hits):
        if out and abs((p - q) - out[-1][2]) <= band and p <= out[-1][1] + length:
            out[-1][1] = p
        else:
            out.append([p, p, p - q])
    return [(max(0, d - band), max(last, d + length) + band, d) for _, last, d in out]


def align(text: np.ndarray, template: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Best local alignment within ``band`` of a diagonal: (matched words, first and last text word).

    Row by row over the template; a cell lies at text word ``diagonal + row + offset - band``. Each cell
    carries its score, matches and first text word.
    """
    width = 2 * band + 1
    score, matched, begin = [0] * (width + 1), [0] * (width + 1), [-1] * (width + 1)
    best = (0, 0, 0, -1)  # score, matches, first, last
    for i, word in enumerate(template.tolist()):
        new_score, new_matched, new_begin = [0] * (width + 1), [0] * (width + 1), [-1] * (width + 1)
        for o in range(width):
            j = diagonal + i + o - band
            if j < 0 or j >= len(text):
                continue
            same = int(text[j]) == word
            options = [(score[o] + (MATCH if same else MISMATCH), matched[o] + same, begin[o] if begin[o] >= 0 else j),
                       (score[o + 1] + GAP, matched[o + 1], begin[o + 1])]
            if o:
                options.append((new_score[o - 1] + GAP, new_matched[o - 1], new_begin[o - 1]))
            top = max(options, key=lambda x: (x[0], x[1]))
            if top[0] > 0:
                new_score[o], new_matched[o], new_begin[o] = top
                if (top[0], top[1]) > best[:2]:
                    best = (top[0], top[1], top[2], j)
        score, matched, begin = new_score, new_matched, new_begin
    return best[1], best[2], best[3]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per match of a template in a row of ``docs`` (``doc_id``, ``text``), none for a text without one.

    ``coverage`` is the share of the template's words that the match aligns, ``start`` and ``stop`` the
    characters (code points) of the text it spans. Of overlapping matches the one with the most
    matched words stays, ties go to the higher coverage, then to the template's name. Null and empty
    texts match nothing; repeated rows and rows with a null id are scanned like any other.
    """
    templates = dict(templates)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(templates)
        for frame in frames:
            rows = []
            for first, raw in batches(frame["text"]):
                words = Words(raw, _TABLE)
                bounds = np.searchsorted(words.doc, np.arange(len(raw) + 1))
                for i in range(len(raw)):
                    a, b = bounds[i], bounds[i + 1]
                    for m in _matches(words.hash[a:b], index, coverage):
                        start, stop = (int(words.start[a + m[3]] - words.doc_start[i]),
                                       int(words.end[a + m[4]] - words.doc_start[i]))
                        before = len(raw[i][:start].decode("utf-8", "replace"))
                        rows.append((frame["doc_id"].iloc[first + i], index.names[m[0]], m[1] / m[2], m[1], m[2],
                                     before, before + len(raw[i][start:stop].decode("utf-8", "replace"))))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, _OUT)


def _matches(words: np.ndarray, index: Index, coverage: float) -> list[tuple[int, int, int, int, int]]:
    """(template, matched words, its words, first and last text word), without overlaps, in order."""
    found = []
    for t, hits in index.candidates(_grams(words)).items():
        template = index.words[t]
        for low, high, diagonal in regions(hits, len(template)):
            part = words[low:high + 1]
            matched, a, b = align(part, template, diagonal - low)
            if matched >= coverage * len(template):
                found.append((t, matched, len(template), low + a, low + b))
    found.sort(key=lambda m: (-m[1], -m[1] / m[2], index.names[m[0]], m[3]))
    kept: list[tuple[int, int, int, int, int]] = []
    for m in found:
        if all(m[4] < k[3] or k[4] < m[3] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[3])
