"""License scan: winnowed fingerprints find candidates, banded alignment measures them.

Templates are split into lower-case words. Hashes of ``SHINGLE`` consecutive words are winnowed (the least
of every ``WINDOW`` in a row is kept) for each document on the fly and looked up in an inverted index from fingerprint to
(template, place). Templates below ``SHORT_WORDS`` words are indexed and probed by every pair of words instead. Places
where enough hits agree up to the band are candidates; there the whole template is aligned to the document word by
word inside the band. A candidate is reported if the matched words cover at least ``min_coverage`` of the template, with
the span from the first to the last matched word.

Nothing is lost up to the coverage: a copy of n words with at most e = n - ceil(min_coverage * n) words replaced, left out or
put in keeps n - 1 - 2 e pairs, and (n - 4 e - 3) / 4 stretches of four words of its own, each of which has a winnowed
fingerprint. So many hits are asked for, within e places. (Where the second number is not positive, which takes
a coverage below 0.8, pairs are used for longer templates too; below a half no pair is sure.)

The templates are a parameter and their index is as large as they are; it goes to the tasks with the code.
Scanning is a map over whole texts.

Defined cases: a null or empty text has no match; a template of one word is looked up by that word;
equal templates are reported under each of their names; overlapping reports of one template keep the
better, then the earlier; repeated rows and null ids are reported like others.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 3
WINDOW = 2
SHORT_WORDS = 25
MIN_COVERAGE = 0.8
_WORD = re.compile(r"\w+")
_LOST = np.int32(-(1 << 20))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_OUT = "doc_id long, license string, coverage double, n_matched int, n_template int, start_char long, end_char long"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int32()), ("n_template", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64())]
)

# Public notices by their usual short names (fixed values).
TEMPLATES = {
    "MIT (statement)": "Released under the MIT License.",
    "Apache-2.0 (statement)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (statement)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (statement)": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
 documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
 copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
 is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
 in all copies or substantial portions of the Software.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
 with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
 or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
 OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
 License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
 License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
 program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
 MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
 following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
 following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
 following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
 provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
 distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


class _Codes(dict):
    """Word -> code, in a cache of bounded size."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = code = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return code


def codes(text: str, known: _Codes) -> np.ndarray:
    words = _WORD.findall(text.lower())
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def fingerprints(words: np.ndarray, shingle: int = SHINGLE, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) that winnowing keeps; all if there are fewer shingles than a window."""
    size = min(shingle, len(words))
    if not size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = (h + words[i : i + n] + np.uint64(1)) * _FACTOR
        h ^= h >> np.uint64(29)
    if n <= window:
        return h, np.arange(n)
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    at = np.unique(np.arange(n - window + 1) + views.argmin(axis=1))
    return h[at], at


def edits(n_words: int, min_coverage: float) -> int:
    """How many of so many template words may be without a match."""
    return n_words - math.ceil(min_coverage * n_words - 1e-9)


class Index:
    """Inverted index of the templates' fingerprints, one table for each length of shingle in use."""

    def __init__(self, templates: Mapping[str, str], min_coverage: float = MIN_COVERAGE):
        known = _Codes()
        self.min_coverage = min_coverage
        self.names = list(templates)
        self.words = [codes(templates[n], known) for n in self.names]
        self.needed = []  # hits that a copy of each template is sure to have
        entries: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            n, e = len(words), edits(len(words), min_coverage)
            stretches = -((4 * e + 3 - n) // 4)
            pairs = n < SHORT_WORDS or stretches < 1
            self.needed.append(max(1, n - 1 - 2 * e if pairs else stretches))
            size = min(2 if pairs else SHINGLE, n)
            # every shingle is indexed: a document's window may keep another one than the template's
            every, at = fingerprints(words, size, 1)
            entries[size] += [(int(h), t, int(p)) for h, p in zip(every, at, strict=True)]
        self.tables = {}
        for size, rows in entries.items():
            if size:
                rows.sort()
                self.tables[size] = (np.array([r[0] for r in rows], np.uint64), [(r[1], r[2]) for r in rows])

    def hits(self, words: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Template -> (place in the document, place in the template) of common fingerprints."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for size, (hashes, places) in self.tables.items():
            if len(words) < size:
                continue
            h, at = fingerprints(words, size, WINDOW if size == SHINGLE else 1)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for i in np.flatnonzero(hi > lo):
                for e in range(lo[i], hi[i]):
                    t, p = places[e]
                    found[t].append((int(at[i]), p))
        return found


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, last matched place) of the whole template at its best place, ``place - template place`` near ``shift``.

    A match counts 2, a word of either side without one -1; words before and after cost nothing.
    """
    n, width = len(template), 2 * band + 1
    steps = np.arange(width)
    score = np.full((n + 1, width + 1), _LOST, np.int32)  # column d of row i: words up to place i - 1 + shift - band + d are used
    move = np.zeros((n + 1, width), np.int8)
    at = shift - band - 1 + steps
    score[0, :width][(at >= -1) & (at < len(words))] = 0
    for i in range(1, n + 1):
        at = at + 1
        inside = (at >= 0) & (at < len(words))
        gain = np.full(width, -1, np.int32)
        gain[inside] += 3 * (words[at[inside]] == template[i - 1])
        both = np.where(inside, score[i - 1, :width] + gain, _LOST)
        left_out = np.where(inside | (at == -1), score[i - 1, 1:] - 1, _LOST)
        best = np.maximum(both, left_out)
        put_in = np.where(inside, np.maximum.accumulate(best + steps) - steps, best)
        score[i, :width] = put_in
        move[i] = np.where(both >= put_in, 1, np.where(left_out >= put_in, 2, 3))
    i, d = n, int(score[n, :width].argmax())
    if score[n, d] <= _LOST // 2:
        return 0, -1, -1
    matched, first, last = 0, -1, -1
    while i > 0:
        if move[i, d] == 1:
            j = i - 1 + shift - band + d
            if template[i - 1] == words[j]:
                matched, first = matched + 1, j
                last = j if last < 0 else last
            i -= 1
        elif move[i, d] == 2:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return matched, first, last


def scan(text: str | None, index: Index, known: _Codes) -> list[tuple[str, int, int, int, int]]:
    """(template, matched words, template words, start, end) of the reports of one whole text."""
    words = codes(text or "", known)
    found: list[tuple[int, int, int, int]] = []
    for t, hits in index.hits(words).items():
        template = index.words[t]
        if len(hits) < index.needed[t]:
            continue
        band = max(2, edits(len(template), index.min_coverage))
        reports = []
        shifts = np.sort(np.fromiter((p - q for p, q in hits), np.int64, len(hits)))
        near = np.searchsorted(shifts, shifts + band, "right") - np.searchsorted(shifts, shifts - band, "left")
        for shift in np.unique(shifts[near >= index.needed[t]]).tolist():
            matched, first, last = align(template, words, shift, band)
            if matched >= index.min_coverage * len(template) - 1e-9:
                reports.append((matched, first, last))
        kept: list[tuple[int, int, int]] = []
        for r in sorted(reports, key=lambda r: (-r[0], r[1], r[2])):
            if all(r[1] > k[2] or r[2] < k[1] for k in kept):
                kept.append(r)
        found += [(t, *r) for r in sorted(kept, key=lambda r: r[1])]
    if not found:
        return []
    # places in the text as given, if lower case has as many words; it has for all but a few letters
    spans = [m.span() for m in _WORD.finditer(text)]
    if len(spans) != len(words):
        spans = [m.span() for m in _WORD.finditer(text.lower())]
    return [(index.names[t], n, len(index.words[t]), spans[a][0], spans[b][1]) for t, n, a, b in found]


def scan_documents(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per report: ``doc_id, license, coverage, n_matched, n_template, start_char, end_char``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = Index(templates, min_coverage), _Codes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for name, n, size, start, end in scan(text.as_py(), index, known):
                    rows.append((doc_id, name, n / size, n, size, start, end))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _OUT)
