"""License scans by patience alignment.

A text is held against every license template. Words that occur once in the template and once
in the stretch of text at hand are anchors; the longest run of anchors in the same order in both is
kept (longest increasing subsequence), and the gaps between kept anchors are aligned in the
same way, by the longest equal run where no word is left that occurs once in both. Coverage is the share of template words that are aligned.

Every whole text is read. A text is aligned with a template only if it holds enough of the
template's words at all: coverage can't be higher than the share of template words (as often as they
occur in the text), which is counted for a whole Arrow chunk at once.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siembra.llm.shared import bound_batches, chunks, text_of
from siembra.llm.textkit import span_hashes, word_bounds

#: Share of a template's words that have to be aligned, within SPREAD times as many words of the text as the template has.
COVERAGE, SPREAD = 0.8, 4.0

# Public license texts and notices by SPDX identifier.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "all-rights-reserved-notice": "All rights reserved.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
} | {
    f"CC-{code}-4.0-notice": f"This work is licensed under a Creative Commons {name} 4.0 International License."
    for code, name in (("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
} | {f"CC-{code}-4.0-short-notice": f"Licensed under CC {code} 4.0." for code in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")}
#: Whole license texts in the folder ``licenses``.
WHOLE = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")
TEMPLATES |= {name: resources.files("siembra.llm").joinpath("licenses", f"{name}.txt").read_text("utf-8") for name in WHOLE}
#: Phrases that have to be aligned word beside word in the text as well: names and versions that tell a license from its neighbours.
KEYS: dict[str, tuple[str, ...]] = {
    "BSD-3-Clause": ("endorse or promote products derived",), "GPL-3.0": ("13. Use with the GNU Affero General Public License.",),
    "MIT-notice": ("the MIT License",), "all-rights-reserved-notice": ("All rights reserved.",), "CC-BY-4.0-notice": ("Creative Commons Attribution 4.0",),
    "Apache-2.0-notice": ("Apache License, Version 2.0",), "Apache-2.0-header": ("Apache License, Version 2.0",),
    "GPL-2.0-notice": ("GNU General Public License, version 2",), "GPL-3.0-notice": ("GNU General Public License, version 3",), "GPL-3.0-header": ("GNU General Public License", "version 3 of the License"),
}
KEYS |= {name: (f"Creative Commons {text.split('Creative Commons ')[1].split()[0]} 4.0",) for name, text in TEMPLATES.items() if "Creative Commons Attribution-" in text and name.endswith("-4.0-notice")}
KEYS |= {name: (f"CC {text.split()[3]} 4.0",) for name, text in TEMPLATES.items() if name.endswith("-short-notice")}
#: A license with such words stands in the place of those that its text holds as well.
BEATS = {"BSD-3-Clause": ("BSD-2-Clause",)}
#: Marks that don't belong to a word at its ends.
MARKS = np.isin(np.arange(256), np.frombuffer(b"\"'().,;:!?[]{}<>*", np.uint8))


def bare_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_bounds`` without marks at the ends of words; words of marks alone stay as they are."""
    first, last, words = word_bounds(data, offsets)
    a, b = first.copy(), last.copy()
    for at, step, edge in ((a, 1, 0), (b, -1, -1)):
        moving = np.arange(len(a))
        while len(moving):
            moving = moving[(a[moving] < b[moving]) & MARKS[data[np.minimum(at[moving] + edge, len(data) - 1)]]]
            at[moving] += step
    empty = a >= b
    return np.where(empty, first, a), np.where(empty, last, b), words


def align(text: list[int], template: list[int], begin: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Aligned places (text, template) in ascending order, by patience alignment of text[begin:end] and all of template."""
    out: list[tuple[int, int]] = []
    todo = [(begin, len(text) if end is None else end, 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            out.append((b - 1, d - 1))
            b, d = b - 1, d - 1
        if a >= b or c >= d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        place = {w: k for k, w in enumerate(template[c:d], c) if in_template[w] == 1 and in_text.get(w) == 1}
        anchors = [(k, place[w]) for k, w in enumerate(text[a:b], a) if w in place]
        chain = _rising(anchors)
        if not chain:
            # every common word stands more than once on a side: the longest equal run
            x, u, n = _longest_run(text, template, a, b, c, d)
            chain = [(x + k, u + k) for k in range(n)]
        if not chain:
            continue
        out += chain
        ends = [(a - 1, c - 1), *chain, (b, d)]
        todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def _longest_run(text: list[int], template: list[int], a: int, b: int, c: int, d: int) -> tuple[int, int, int]:
    """Begin in text[a:b] and template[c:d], and length, of their longest equal run; the first of equally long ones."""
    where: dict[int, list[int]] = {}
    for k in range(c, d):
        where.setdefault(template[k], []).append(k)
    best, runs = (a, c, 0), {}
    for k in range(a, b):
        now = {}
        for u in where.get(text[k], ()):
            n = now[u] = runs.get(u - 1, 0) + 1
            if n > best[2]:
                best = (k - n + 1, u - n + 1, n)
        runs = now
    return best


def _rising(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of anchors whose second places rise; of equally long ones, that of the lowest piles."""
    tops: list[int] = []
    last: list[int] = []
    before = []
    for k, (_, at) in enumerate(anchors):
        pile = bisect_left(tops, at)
        before.append(last[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(at)
            last.append(k)
        else:
            tops[pile], last[pile] = at, k
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(anchors[k])
        k = before[k]
    return chain[::-1]


def _windows(places: np.ndarray, reach: int, need: int) -> Iterator[tuple[int, int]]:
    """Rows of ``places`` in dense stretches; of a stretch longer than ``reach`` words, windows of that length that slide over it.

    Up to twice that length it also counts as a whole, after its parts.
    """
    for low, high in _dense(places, reach, need):
        begin, end = places[low], places[high - 1] + 1
        if end - begin > reach:
            step = max(1, reach // 4)
            for at in range(begin, end - reach + step, step):
                a, b = np.searchsorted(places, [at, at + reach])
                if b - a >= need:
                    yield int(a), int(b)
        if end - begin <= 2 * reach:
            yield low, high


def _dense(places: np.ndarray, reach: int, need: int) -> Iterator[tuple[int, int]]:
    """Rows of ``places`` that belong to stretches in which ``need`` of them stand within ``reach`` words."""
    if len(places) < need:
        return
    starts = np.flatnonzero(places[need - 1 :] - places[: len(places) - need + 1] < reach)
    if len(starts):
        breaks = np.flatnonzero(np.diff(starts) >= need) + 1
        for part in np.split(starts, breaks):
            yield int(part[0]), int(part[-1]) + need


class Templates:
    """Word hashes of the templates."""

    def __init__(self, texts: Mapping[str, str]) -> None:
        self.names = [k for k, v in texts.items() if v and v.split()]
        self.words = [self.hashes(texts[k]) for k in self.names]
        self.vocabulary = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)
        self.limits = [Counter(w.tolist()) for w in self.words]
        self.keys = [[self._key(w, self.hashes(key)) for key in KEYS.get(k, ())] if texts[k] is TEMPLATES.get(k) else [] for k, w in zip(self.names, self.words, strict=True)]
        self.losers = {x for k in self.names for x in BEATS.get(k, ())}

    @staticmethod
    def _key(words: np.ndarray, key: np.ndarray) -> range:
        """Places of the key in the template."""
        at = next(k for k in range(len(words) - len(key) + 1) if (words[k : k + len(key)] == key).all())
        return range(at, at + len(key))

    @staticmethod
    def hashes(text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        first, last, _ = bare_words(data, np.array([0, len(data)]))
        return span_hashes(data, first, last)


def _together(pairs: list[tuple[int, int]], keys: list[range]) -> bool:
    """Whether every word of each key is aligned, with nothing between them in the text."""
    place = {at: k for k, at in pairs}
    return all(key[0] in place and all(place.get(at) == place[key[0]] + n for n, at in enumerate(key)) for key in keys)


def scan(data: np.ndarray, offsets: np.ndarray, templates: Templates, coverage: float, spread: float = SPREAD) -> Iterator[tuple[int, str, float, int, int, int]]:
    """(text, license, coverage, start word, end word, aligned words) of the best stretch of each text and template."""
    first, last, words = bare_words(data, offsets)
    hashes = span_hashes(data, first, last)
    if not len(templates.vocabulary) or not len(hashes):
        return
    at = np.searchsorted(templates.vocabulary, hashes)
    hit = np.flatnonzero(templates.vocabulary[np.minimum(at, len(templates.vocabulary) - 1)] == hashes)
    cut = np.searchsorted(hit, words)
    least = min(max(1, int(np.ceil(coverage * len(w)))) for w in templates.words)
    for doc in np.flatnonzero(np.diff(cut) >= least):
        places = hit[cut[doc] : cut[doc + 1]]
        found = hashes[places]
        counts = Counter(found.tolist())
        start, kept = int(words[doc]), {}
        for name, template, limit, keys in zip(templates.names, templates.words, templates.limits, templates.keys, strict=True):
            need = max(1, int(np.ceil(coverage * len(template))))
            if len(places) < need or sum(min(n, counts.get(w, 0)) for w, n in limit.items()) < need:
                continue
            own = places[np.isin(found, template)]
            words_of_own = hashes[own].tolist()
            for low, high in _windows(own, math.ceil(spread * len(template)), need):
                # words that aren't the template's can't be aligned, so only its own are
                pairs = [(int(own[low + k]), at) for k, at in align(words_of_own[low:high], template.tolist())]
                share = len(pairs) / len(template)
                if share >= coverage and _together(pairs, keys):
                    kept.setdefault(name, []).append((int(doc), name, share, pairs[0][0] - start, pairs[-1][0] + 1 - start, len(pairs)))
                    if share == 1 and name not in templates.losers:
                        break
        for name, rows in kept.items():
            taken = [r for k, v in kept.items() if name in BEATS.get(k, ()) for r in v]
            rows = [r for r in rows if not any(r[3] < t[4] and t[3] < r[4] for t in taken)]
            if rows:
                yield max(rows, key=lambda r: r[2])


def scan_licenses(df: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE, spread: float = SPREAD) -> DataFrame:
    """Licenses found in whole texts; one row for each text and license.

    Columns: the id, ``license``, ``coverage`` (share of template words aligned, >= ``coverage``),
    ``start_word`` and ``end_word`` (exclusive) of the aligned stretch, ``n_words`` aligned. Of several
    stretches the one with the highest coverage counts, then the first. Null, empty and other texts
    without a license have no row; repeated rows have a row each; empty templates are left out.
    A-Z count as a-z, marks at the ends of words don't count, the phrases of ``KEYS`` have to stand together. The aligned words have to stand within ``spread`` times the template's length (so three
    other words may follow each of its words); words further apart aren't a license. Two copies
    of a license in a text are one row. An empty table gives an empty result. Other columns aren't read.
    """
    bound_batches(df.sparkSession)
    known = Templates(templates)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), *(T.StructField(n, T.LongType()) for n in ("start_word", "end_word", "n_words"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches):
            rows = list(scan(data, offsets, known, coverage, spread))
            columns = [part.column("id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[k] for r in rows], pa.int64()) for k in (3, 4, 5))], names=schema.names)

    return df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, schema)
