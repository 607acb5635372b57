"""License scans: winnowed template fingerprints, then banded alignment.

Texts and templates are read as runs of ASCII letters and digits (lower
case) and non-ASCII characters.  Every template's word k-grams are hashed
and winnowed (of each window of consecutive hashes the smallest is kept);
the kept hashes form an inverted index hash -> (template, place).  A text's
own winnowed hashes are looked up in it, so a run of at least k + window - 1
words that a text shares with a template always meets.  The hits of a
template give diagonals; each group of diagonals at most a band apart is a
candidate and is aligned in a band around them (local alignment: match 1,
mismatch and gap -1); the span of a match is masked and the rest of the
group aligned again, until no match is left.  A match reports the template's words found in order, their share of
the template (coverage) and the span of the text; of overlapping matches of
one template the one with most words is kept.

The templates are the only data sent to every task; their size is checked.
The text side is one pass without a shuffle.  Defined results: null or blank
text and texts without a match give no row; templates without words never
match; repeated rows are reported each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palletwise.llm import _text
from palletwise.session import ship_package

GRAM = 3
WINDOW = 3
BAND = 8
MIN_COVERAGE = 0.8
MAX_TEMPLATE_WORDS = 1_000_000

# fixed values: public notices and license texts to look for
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer.""",
}

_FOLD = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in bytes(range(256)).lower())


def winnow(grams: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of each window of consecutive grams of
    one text (the last of equals); a text with fewer grams keeps its smallest."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    keep = np.zeros(n, dtype=bool)
    size = min(window, n)
    at = np.arange(n - size + 1)
    best, low = at.copy(), grams[at].copy()
    for j in range(1, size):
        less = grams[at + j] <= low
        best[less], low[less] = (at + j)[less], grams[at + j][less]
    whole = doc[at] == doc[at + size - 1]
    keep[best[whole]] = True
    count = np.bincount(doc)
    for d in np.flatnonzero((count > 0) & (count < window)).tolist():  # short texts
        lo, hi = np.searchsorted(doc, [d, d + 1])
        keep[lo + int(np.argmin(grams[lo:hi]))] = True
    return np.flatnonzero(keep)


def _fingerprints(texts: list[bytes], gram: int, window: int):
    """(words, word hashes, places, gram hashes) of folded texts."""
    words = _text.Words([t.translate(_FOLD) for t in texts])
    h = words.hashes()
    g, whole = words.windows(h, gram, seed=5)
    at = np.flatnonzero(whole)
    kept = at[winnow(g[at], words.doc[at], window)]
    return words, h, kept, g[kept]


class Index:
    """Inverted index of the templates' fingerprints, sorted by hash."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW):
        self.names = sorted(templates)
        words, h, at, g = _fingerprints([templates[n].encode() for n in self.names], gram, window)
        if len(words) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
        self.words = [h[words.first[i] : words.first[i + 1]] for i in range(len(self.names))]
        order = np.argsort(g, kind="stable")
        self.hash, owner = g[order], words.doc[at[order]]
        self.template, self.place = owner, at[order] - words.first[owner]

    def hits(self, grams: np.ndarray):
        """(position in ``grams``, index entry) of every equal hash."""
        lo = np.searchsorted(self.hash, grams, side="left")
        n = np.searchsorted(self.hash, grams, side="right") - lo
        which = np.repeat(np.arange(len(grams)), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return which, np.repeat(lo, n) + step


def align(template: list[int], text: list, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment with text place - template place in [low, high]:
    (words matched, first text word, end of the text span).  Of equal scores
    the one with more matches, then the earlier, wins."""
    best = (0, 0, 0, 0)
    width = high - low + 1
    above = [(0, 0, 0)] * (width + 1)  # (score, matches, start) by diagonal of the last row
    for i, t in enumerate(template):
        row, left = [], None
        for d in range(width):
            j = i + low + d
            if not 0 <= j < len(text):
                row.append((0, 0, max(0, min(j + 1, len(text)))))
                left = None
                continue
            s, m, start = above[d] if i and j else (0, 0, j)
            if s <= 0:
                s, m, start = 0, 0, j
            cell = (s + 1, m + 1, start) if text[j] == t else (s - 1, m, start)
            if i and d + 1 < width and above[d + 1][0] - 1 > cell[0]:  # template word left out
                cell = (above[d + 1][0] - 1, above[d + 1][1], above[d + 1][2])
            if left is not None and left[0] - 1 > cell[0]:  # text word too many
                cell = (left[0] - 1, left[1], left[2])
            if cell[0] < 0:
                cell = (0, 0, j + 1)
            if (cell[0], cell[1]) > best[:2]:
                best = (cell[0], cell[1], cell[2], j + 1)
            row.append(cell)
            left = cell
        above = [*row, (0, 0, 0)]
    return best[1:]


def matches(index: Index, template: int, seeds: list[int], text: list[int], band: int, least: int = 1) -> list[tuple[int, int, int]]:
    """Non-overlapping matches (words, start, end) of a template, given the
    diagonals its fingerprints hit.  Matches of fewer than ``least`` words may
    be left out."""
    own = index.words[template].tolist()
    known = set(own)
    found, seeds, i = set(), sorted(set(seeds)), 0
    while i < len(seeds):
        j = i
        while j + 1 < len(seeds) and seeds[j + 1] - seeds[i] <= band:
            j += 1
        low, high = seeds[i] - band, seeds[j] + band
        base = max(0, low)
        part: list = text[base : max(base, high + len(own) + 1)]
        # until too few of the template's words are left for another match
        while sum(w in known for w in part) >= max(least, 1):
            n, a, b = align(own, part, low - base, high - base)
            if not n:
                break
            found.add((n, base + a, base + b))
            part[a:b] = [None] * (b - a)
        i = j + 1
    # the greatest stay, each if it overlaps none before it
    kept: list[tuple[int, int, int]] = []
    for n, a, b in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
        at = bisect.bisect_left(kept, a, key=lambda m: m[1])
        if (at == len(kept) or kept[at][1] >= b) and (at == 0 or kept[at - 1][2] <= a):
            kept.insert(at, (n, a, b))
    return kept


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE,
         gram: int = GRAM, window: int = WINDOW, band: int = BAND) -> DataFrame:
    """(doc_id, license, matched, coverage, start_word, end_word, start_char,
    end_char): one row per match that covers at least ``min_coverage`` of
    its template.  Word places count the text's folded words."""
    ship_package(docs.sparkSession)
    given = TEMPLATES if templates is None else templates
    Index(given, gram, window)  # checks the size on the driver
    schema = ("doc_id long, license string, matched int, coverage double, start_word int, end_word int, "
              "start_char int, end_char int")

    def run(batches):
        import pyarrow as pa

        index = Index(given, gram, window)
        for part in _text.slices(batches):
            texts = _text.as_bytes(part.column("text"))
            words, h, at, g = _fingerprints(texts, gram, window)
            which, entry = index.hits(g)
            doc = words.doc[at[which]]
            diagonal = at[which] - words.first[doc] - index.place[entry]
            groups: dict[tuple[int, int], list[int]] = {}
            for d, t, x in zip(doc.tolist(), index.template[entry].tolist(), diagonal.tolist(), strict=True):
                groups.setdefault((d, t), []).append(x)
            out = []
            for (d, t), seeds in sorted(groups.items()):
                lo, hi = int(words.first[d]), int(words.first[d + 1])
                least = math.floor(min_coverage * len(index.words[t]))
                for n, a, b in matches(index, t, seeds, h[lo:hi].tolist(), band, least):
                    coverage = n / len(index.words[t])
                    if coverage >= min_coverage:
                        left, right = (int(words.start[lo + a] - words.text_start[d]), int(words.end[lo + b - 1] - words.text_start[d]))
                        chars = len(texts[d][:left].decode())
                        out.append((d, index.names[t], n, coverage, a, b, chars, chars + len(texts[d][left:right].decode())))
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(cols[0], pa.int64())), *[pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True)]],
                ["doc_id", "license", "matched", "coverage", "start_word", "end_word", "start_char", "end_char"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
