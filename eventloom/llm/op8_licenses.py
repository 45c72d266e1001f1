"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import documents
from eventloom.llm.op1_decontaminate import LETTERS
from eventloom.llm.textops import LOWER, batches, mix, prefix_hash

#: Words of a fingerprint, fingerprints of a window: every run of GRAM + WINDOW - 1 shared words is found.
GRAM, WINDOW = 3, 2
#: Half width of the alignment's band, and the least share of a template's words that must match.
BAND, COVERAGE = 12, 0.8
#: Bound of the broadcast index.
TEMPLATE_CHARS = 20_000_000

#: License notices.
TEMPLATES = (
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
#: Whole license texts, by their SPDX identifiers.
LICENSES = (
    ("MIT", f"""{dict(TEMPLATES)["MIT-grant"]}
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_AS_IS}"""),
    ("BSD-2-Clause", f"{_BSD_CONDITIONS}\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"""{_BSD_CONDITIONS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission.
{_BSD_WARRANTY}"""),
    ("ISC", f"""{dict(TEMPLATES)["ISC-grant"]}
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software
must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as
such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution."""),
    ("Unlicense", f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and
all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and
future rights to this software under copyright law.
{_AS_IS.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "THE AUTHORS")}"""),
)
TEMPLATES += LICENSES


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of lower-case words of letters and digits, and each text's first word."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = LETTERS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    p, down = prefix_hash(LOWER[data])
    return mix((p[ends] - p[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends, np.searchsorted(starts, offsets)


def fingerprints(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: the smallest of each WINDOW consecutive GRAM-word hashes, and its place. A text with fewer grams keeps its smallest."""
    g = np.zeros(max(len(hashes) - GRAM + 1, 0), np.uint64)
    for j in range(GRAM):
        g = g * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(g)]
    g = mix(g)
    text = np.searchsorted(first, np.arange(len(g)), "right") - 1
    ok = np.arange(len(g)) + GRAM <= first[np.minimum(text + 1, len(first) - 1)]
    g[~ok] = np.uint64(0xFFFFFFFFFFFFFFFF)
    keep = np.zeros(len(g), bool)
    if len(g) >= WINDOW:
        rows = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
        whole = np.lib.stride_tricks.sliding_window_view(ok, WINDOW).all(1)
        keep[(np.arange(len(rows)) + rows.argmin(1))[whole]] = True
    few = np.diff(first) - GRAM + 1
    for t in np.flatnonzero((few > 0) & (few < WINDOW)):
        keep[first[t] + g[first[t] : first[t] + few[t]].argmin()] = True
    at = np.flatnonzero(keep & ok)
    return g[at], at


class Index:
    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        self.words: list[list[int]] = []
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text) in enumerate(templates):
            for _, data, offsets in batches(pa.array([text], pa.large_string())):
                h, _, _, first = words(data, offsets)
                self.words.append(h.tolist())
                for f, at in zip(*(x.tolist() for x in fingerprints(h, first)), strict=True):
                    postings[f].append((k, at))
        self.postings = dict(postings)
        self.keys = np.array(sorted(postings), np.uint64)

    def search(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, template, first and last matched word, matched words) for each place where a template is covered well enough."""
        f, at = fingerprints(hashes, first)
        if not len(self.keys) or not len(f):
            return
        hit = np.flatnonzero(self.keys[np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)] == f)
        found: dict[tuple[int, int], list[int]] = defaultdict(list)
        for x, p in zip(f[hit].tolist(), at[hit].tolist(), strict=True):
            text = int(np.searchsorted(first, p, "right")) - 1
            for k, q in self.postings[x]:
                found[text, k].append(p - q)
        for (text, k), diagonals in found.items():
            for lo, hi, n in self.finds(k, hashes, int(first[text]), int(first[text + 1]), Counter(diagonals)):
                yield text, k, lo, hi, n

    def finds(self, k: int, hashes: np.ndarray, start: int, end: int, diagonals: Counter[int]) -> list[tuple[int, int, int]]:
        """All finds of a template among the words start to end, which don't overlap: around the best supported diagonals first, in what earlier finds leave."""
        template = self.words[k]
        need = COVERAGE * len(template)
        got: list[tuple[int, int, int]] = []  # in order of place
        for d, _ in sorted(diagonals.items(), key=lambda x: (-x[1], x[0])):
            lo, hi = max(start, d - BAND), min(end, d + len(template) + BAND)
            i = max(bisect_right(got, (lo,)) - 1, 0)
            parts = []  # what is left of lo to hi
            while i < len(got) and got[i][0] < hi:
                parts.append((lo, got[i][0]))
                lo = max(lo, got[i][1] + 1)
                i += 1
            parts.append((lo, hi))
            while parts:
                lo, hi = parts.pop()
                if hi - lo < need:
                    continue
                part = hashes[lo:hi].tolist()
                here = set(part)
                if sum(w in here for w in template) < need:
                    continue
                best = align(template, part, d - lo)
                if best and best[2] >= need:
                    insort(got, (lo + best[0], lo + best[1], best[2]))
                    parts += [(lo, lo + best[0]), (lo + best[1] + 1, hi)]
        return got


def align(template: list[int], text: list[int], diagonal: int) -> tuple[int, int, int] | None:
    """Best common subsequence of words in a band around a diagonal; of those with most words, the one that ends first and spans least.

    Returns first and last matched place in text, and how many words match.
    """
    width = 2 * BAND + 1
    best = None
    old = [(0, 0, -1)] * (width + 1)  # (words, -first place, last place) by place in the band
    for i, w in enumerate(template):
        new: list[tuple[int, int, int]] = []
        for b in range(width):
            j = i + diagonal + b - BAND
            cell = max(old[b + 1], new[b - 1] if b else (0, 0, -1), key=lambda x: (x[0], x[1]))
            if 0 <= j < len(text) and text[j] == w:
                n, s, _ = old[b]
                up = (n + 1, s if n else -j, j)
                if (up[0], up[1]) > (cell[0], cell[1]):
                    cell = up
            new.append(cell)
            if cell[0] and (best is None or (cell[0], cell[1]) > (best[0], best[1])):
                best = cell
        old = [*new, (0, 0, -1)]
    return None if best is None else (-best[1], best[2], best[0])


def licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, template, coverage, start, end (bytes of the UTF-8 text), words: one row for each find.

    A template is found where COVERAGE of its words or more stand in order, in a band around a shared fingerprint. Case and
    punctuation don't count. Null, empty and short texts have no finds; templates with fewer than GRAM words are never found;
    repeated rows are searched each; two templates may share a span. Other columns are not read. An empty table gives an
    empty result. templates: at most TEMPLATE_CHARS characters.
    """
    templates = list(TEMPLATES if templates is None else templates)
    if sum(len(t) for _, t in templates) > TEMPLATE_CHARS:
        raise ValueError(f"templates have more than {TEMPLATE_CHARS} characters")
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates))

    def find(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for rb in batch_iter:
            for i, data, offsets in batches(rb.column(1)):
                h, starts, ends, first = words(data, offsets)
                out = [
                    (rb.column(0)[i + t].as_py(), index.names[k], n / len(index.words[k]), int(starts[a] - offsets[t]), int(ends[b] - offsets[t]), n)
                    for t, k, a, b, n in index.search(h, first)
                ]
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "template", "coverage", "start", "end", "words"])

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, template string, coverage double, start long, end long, words long")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(documents(spark, sf_dir))
