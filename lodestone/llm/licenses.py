"""License notices by MinHash bands over overlapping windows, then exact shingle containment.

Templates and documents are lower-case runs of letters and digits, as five-word shingles.  A template of
T shingles belongs to the smallest window class c with T <= c, of ``CLASSES`` or, for a whole license, of
further ones, each four times the one before; windows of 2c shingles at a
stride of c hold any occurrence of it whole.  With T > c/4 the similarity of window and template is at
least 1/8, so 64 bands of one row meet with a probability of at least 1 - (7/8)^64 = 0.9998.  A window that
shares a band with a template is verified: the share of the template's shingles in the window must reach
0.8.

A window's match is dropped if one of another template, contained better, matches most of its shingles at the
same words: the two are variants and the better one is meant.  Licenses that stand near each other or one
within the other are all reported.  Null and empty texts
match nothing; the best window left of each document and template is reported, the
first on ties; templates that are contained equally well are both reported.  Repeated rows are each reported.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lodestone.llm.shingles import K, WordHashes, shingle_hashes

BANDS, CONTAINED = 64, 0.8
CLASSES = (4, 16, 64, 256, 1024)
SHINGLES_AT_ONCE = 100_000
_TOKEN = re.compile(r"[^\W_]+")

#: Notices of common licenses.
TEMPLATES = {
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 notice": "Licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 notice": "Licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0 notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY long notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT notice": "Released under the MIT License.",
    "BSD-3-Clause notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC disclaimer": "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause third condition": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "LGPL header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
}


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """Five-word shingle hashes; none for a text under five words."""
    words = [w.encode() for w in _TOKEN.findall(text.lower())] if text else []
    if len(words) < K:
        return np.zeros(0, dtype=np.uint64)
    return shingle_hashes(np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words)))


def _multipliers() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 32, BANDS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


class Match(NamedTuple):
    """A window that holds a template, with the template's shingles in it by their place in the document."""

    share: float
    template: int
    start: int
    shingles: dict[int, int]


def _meant(found: list[Match]) -> list[Match]:
    """The matches of a document that are not a better match's variant, best first."""
    kept: list[Match] = []
    claims: dict[int, list[int]] = {}
    for m in sorted(found, key=lambda m: (-m.share, m.template, m.start)):
        own = len(set(m.shingles.values()))
        rivals = {k for p in m.shingles for k in claims.get(p, ()) if kept[k].share > m.share and kept[k].template != m.template}
        if any(2 * len({s for p, s in m.shingles.items() if p not in kept[k].shingles}) < own for k in rivals):
            continue
        for p in m.shingles:
            claims.setdefault(p, []).append(len(kept))
        kept.append(m)
    return kept


def window_classes(largest: int) -> list[int]:
    """The window classes that hold a template of so many shingles."""
    classes = list(CLASSES)
    while classes[-1] < largest:
        classes.append(4 * classes[-1])
    return classes


class Scanner:
    """Templates with their band values, by window class."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        known = WordHashes()
        self.sets = [np.unique(shingles(t, known)) for t in templates.values()]
        if min(map(len, self.sets), default=1) == 0:
            raise ValueError(f"a template needs {K} words")
        self.factors = _multipliers()
        self.by_class = {}
        classes = window_classes(max(map(len, self.sets), default=0))
        for c, before in zip(classes, (0, *classes), strict=False):
            members = [i for i, s in enumerate(self.sets) if before < len(s) <= c]
            if members:
                least = np.array([[((self.sets[i] >> np.uint64(32)).astype(np.uint32) * f).min() for i in members] for f in self.factors], dtype=np.uint32)
                marks = np.zeros((BANDS, 1 << 16), dtype=bool)
                for j in range(BANDS):
                    marks[j, least[j] >> 16] = True
                self.by_class[c] = (np.array(members), least, marks)

    def find(self, texts) -> list[tuple[int, int, float, int]]:
        """(row, template, containment, first shingle of the window), the best window of each row and template."""
        known = WordHashes()
        matches: dict[int, list[Match]] = {}
        part: list[tuple[int, np.ndarray]] = []
        n = 0
        for i, t in enumerate(texts):
            s = shingles(t, known)
            if len(s):
                part.append((i, s))
                n += len(s)
            if n > SHINGLES_AT_ONCE:
                self._scan(part, matches)
                part, n = [], 0
        if part:
            self._scan(part, matches)
        out = []
        for r, found in sorted(matches.items()):
            best: dict[int, Match] = {}
            for m in _meant(found):
                best.setdefault(m.template, m)
            out += [(r, t, m.share, m.start) for t, m in sorted(best.items())]
        return out

    def _scan(self, part, matches) -> None:
        lengths = np.array([len(s) for _, s in part])
        flat = np.concatenate([s for _, s in part])
        head = (flat >> np.uint64(32)).astype(np.uint32)
        layouts = []
        for c in self.by_class:
            per_doc = -(-lengths // c)
            first = np.cumsum(per_doc) - per_doc
            owner = np.repeat(np.arange(len(part)), per_doc)
            offset = (np.arange(len(owner)) - first[owner]) * c
            starts = (np.cumsum(lengths) - lengths)[owner] + offset
            layouts.append((c, owner, offset, starts, np.flatnonzero(owner[1:] == owner[:-1])))
        hits: set[tuple[int, int, int]] = set()
        for j, f in enumerate(self.factors):
            values = head * f
            for c, owner, _, starts, same in layouts:
                low = np.minimum.reduceat(values, starts)
                low[same] = np.minimum(low[same], low[same + 1])
                members, least, marks = self.by_class[c]
                for w in np.flatnonzero(marks[j, low >> 16]):
                    for m in members[least[j] == low[w]]:
                        hits.add((c, int(w), int(m)))
        for c, owner, offset, _, _ in layouts:
            for _, w, m in sorted(h for h in hits if h[0] == c):
                row, s = part[owner[w]]
                window = s[offset[w] : offset[w] + 2 * c]
                share = float(np.isin(self.sets[m], window).mean())
                if share >= CONTAINED:
                    at = np.flatnonzero(np.isin(window, self.sets[m]))
                    matches.setdefault(row, []).append(Match(share, m, int(offset[w]), dict(zip((at + offset[w]).tolist(), window[at].tolist(), strict=True))))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, license, containment, window_start`` (in words) for every document that holds a notice."""
    templates = TEMPLATES if templates is None else templates

    def run(batches):
        scanner = Scanner(templates)
        for b in batches:
            found = scanner.find(b["text"])
            if not found:
                continue
            yield pd.DataFrame({"doc_id": b["doc_id"].iloc[[f[0] for f in found]].to_numpy(), "license": [scanner.names[f[1]] for f in found], "containment": [f[2] for f in found], "window_start": [f[3] for f in found]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, license string, containment double, window_start long")
