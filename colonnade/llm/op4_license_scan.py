"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

A word is a run of ASCII letters and digits or bytes over 127, in lower case; a shingle is five
words, or all words of a template that has fewer. Texts are read in windows of 1, 2, 4, ... 32
shingles, which step by a quarter of their width; a template is looked for in windows of the
largest width that it holds, and gives a signature for each of its own windows. A signature has ``BANDS`` bands of
``ROWS`` minima. A text window meets a template window of Jaccard similarity j in some band with
probability 1 - (1 - j**ROWS)**BANDS: at j = 0.8 over 0.9999999, at j = 0.5 over 0.98, at j = 1 always.
A template that stands unchanged in a text has, for widths up to 4, a text window equal to a
template window; for wider ones too, since template windows start at every shingle.

A retrieved template is verified around the window: the greatest number of its distinct shingles
in a stretch of ceil(m / 0.8) text shingles, over its own number m, must be 0.8 or more.

Defined cases: null, empty and short texts have no matches; repeated rows each have theirs; an
empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, map_arrow, mix, prefix_hash, sliding_min, span_hash, text_bytes

WORDS, CONTAINMENT = 5, 0.8
BANDS, ROWS = 16, 2
WIDTHS = (1, 2, 4, 8, 16, 32)
SCHEMA = "doc_id long, license string, first_byte long, end_byte long, containment double"

#: Fixed public notices and license passages.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit-notice": "Released under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "gpl-3.0-notice": "licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "zlib-grant": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-dedication": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}

_FOLD = np.zeros(256, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_CODES = np.random.default_rng(44).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
#: Follows a block's shingles, so that windows may reach past its end; never a minimum.
_AFTER = np.full(WIDTHS[-1] - 1, 0xFFFFFFFFFFFFFFFF, np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first byte, end byte) of each run of ``words`` words within a text; bytes count from the text's start."""
    folded = _FOLD[data]
    solid = folded > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    left = np.concatenate([[False], solid[:-1]])[: len(data)]
    right = np.concatenate([solid[1:], [False]])[: len(data)]
    start = np.flatnonzero(solid & (~left | edge[:-1]))
    end = np.flatnonzero(solid & (~right | edge[1:])) + 1
    prefix = prefix_hash(_CODES[folded])
    h = span_hash(prefix, start, end)
    text = np.searchsorted(offsets, start, side="right") - 1
    n = max(len(h) - words + 1, 0)
    if not n:
        return h[:0], text[:0], start[:0], end[:0]
    at = np.flatnonzero(text[:n] == text[words - 1 :])
    own = text[at]
    return span_hash(prefix_hash(h), at, at + words), own, start[at] - offsets[own], end[at + words - 1] - offsets[own]


class Templates:
    def __init__(self, texts: dict[str, str]):
        self.names = list(texts)
        self.sets: list[np.ndarray] = []
        found: dict[int, dict[str, list]] = {w: {"key": [], "template": []} for w in WIDTHS}
        for k, name in enumerate(self.names):
            data = np.frombuffer(texts[name].encode(), np.uint8)
            h, *_ = shingles(data, np.array([0, len(data)]))
            if not len(h):
                raise ValueError(f"{name} has under {WORDS} words")
            self.sets.append(np.unique(h))
            width = max(w for w in WIDTHS if w <= len(h))
            for band in range(BANDS):
                keys = np.unique(band_keys(h, width, band))
                found[width]["key"].append(keys)
                found[width]["template"].append(np.full(len(keys), k))
        self.tables = {}
        for w, f in found.items():
            if f["key"]:
                key, template = np.concatenate(f["key"]), np.concatenate(f["template"])
                order = np.argsort(key, kind="stable")
                filter_ = np.zeros(1 << 16, bool)
                filter_[(key & np.uint64(0xFFFF)).astype(np.int64)] = True
                self.tables[w] = (key[order], template[order], filter_)
        self.longest = max(map(len, self.sets))


def band_keys(h: np.ndarray, width: int, band: int, minima: list[np.ndarray] | None = None) -> np.ndarray:
    """The band's key for each window of ``width`` shingles."""
    if minima is None:
        minima = [sliding_min(mix(h ^ _SEEDS[band * ROWS + r]), width) for r in range(ROWS)]
    key = np.full(len(minima[0]), band + 1, np.uint64)
    for m in minima:
        key = mix(key * np.uint64(31) + m)
    return key


def candidates(h: np.ndarray, text: np.ndarray, templates: Templates) -> set[tuple[int, int]]:
    """(place of a window's first shingle, template) for every text window that meets a template's in some band."""
    found: set[tuple[int, int]] = set()
    for band in range(BANDS):
        minima, have = [np.append(mix(h ^ _SEEDS[band * ROWS + r]), _AFTER) for r in range(ROWS)], 1
        for width in WIDTHS:
            while have < width:
                step = min(have, width - have)
                minima = [np.minimum(m[:-step], m[step:]) for m in minima]
                have += step
            if width not in templates.tables:
                continue
            keys, owner, filter_ = templates.tables[width]
            step = max(1, width // 4)
            at = np.arange(0, len(h), step)
            key = band_keys(h, width, band, [m[: len(h) : step] for m in minima])
            maybe = np.flatnonzero(filter_[(key & np.uint64(0xFFFF)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, key[maybe], "left"), np.searchsorted(keys, key[maybe], "right")
            for i, a, b in zip(at[maybe[hi > lo]].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                found.update((i, t) for t in owner[a:b].tolist())
    return found


def verify(h: np.ndarray, wanted: np.ndarray) -> list[tuple[int, int, int]]:
    """Places (first shingle, last shingle, distinct shingles held) of a template in a run of text shingles.

    Looks at every stretch of ceil(m / 0.8) shingles; of overlapping matching stretches the first fullest stands.
    """
    hits = np.flatnonzero(np.isin(h, wanted))
    if len(hits) < CONTAINMENT * len(wanted):
        return []
    reach = int(np.ceil(len(wanted) / CONTAINMENT))
    out: list[tuple[int, int, int]] = []
    kinds = np.searchsorted(wanted, h[hits])
    for i, first in enumerate(hits.tolist()):
        j = int(np.searchsorted(hits, first + reach))
        held = len(set(kinds[i:j].tolist()))
        if held >= CONTAINMENT * len(wanted):
            place = (first, int(hits[j - 1]), held)
            if out and first <= out[-1][1]:
                if held > out[-1][2]:
                    out[-1] = place
            else:
                out.append(place)
    return out


def scan_block(data: np.ndarray, offsets: np.ndarray, templates: Templates) -> list[tuple[int, int, int, int, float]]:
    """(text, template, first byte, end byte, containment) of each verified place in a block of texts."""
    h, text, first, end = shingles(data, offsets)
    out: list[tuple[int, int, int, int, float]] = []
    regions: dict[tuple[int, int], list[tuple[int, int]]] = {}
    begins = np.searchsorted(text, np.arange(len(offsets)))
    for at, t in sorted(candidates(h, text, templates)):
        slack = 2 * int(np.ceil(len(templates.sets[t]) / CONTAINMENT))
        reach = [(int(text[at]), at)]
        if at + WIDTHS[-1] < len(text) and text[at + WIDTHS[-1]] != text[at] or at + WIDTHS[-1] >= len(text):
            reach += [(int(x), at) for x in np.unique(text[at : at + WIDTHS[-1]]) if x != text[at]]  # a window may reach into the next texts
        for doc, _ in reach:
            lo, hi = max(at - slack, int(begins[doc])), min(at + WIDTHS[-1] + slack, int(begins[doc + 1]))
            if lo < hi:
                spans = regions.setdefault((doc, t), [])
                if spans and lo <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
                else:
                    spans.append((lo, hi))
    for (doc, t), spans in sorted(regions.items()):
        for lo, hi in spans:
            for a, b, held in verify(h[lo:hi], templates.sets[t]):
                out.append((doc, t, int(first[lo + a]), int(end[lo + b]), held / len(templates.sets[t])))
    return out


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """One row per place of a template in a text, in one pass; the templates travel with the function, so must be few."""
    templates = Templates(texts or TEMPLATES)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            rows = scan_block(*text_bytes(batch.column(1)), templates)
            if rows:
                doc, t, first, end, held = zip(*rows, strict=True)
                ids = batch.column(0).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array([templates.names[i] for i in t]), pa.array(first, pa.int64()), pa.array(end, pa.int64()), pa.array(held, pa.float64())], names=["doc_id", "license", "first_byte", "end_byte", "containment"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scanned, SCHEMA)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
