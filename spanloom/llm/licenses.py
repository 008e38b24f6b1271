"""Licence scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Texts and templates are words in lower case without punctuation, in shingles of five words; a text or template of fewer words is one
shingle. Templates are sorted into classes by their number of shingles, more than B / 2 and at most B for a class of window block B.
A text is cut into blocks of B shingles, and each two neighbouring blocks are a window, so a template copy lies whole in some window.
A window with at least CONTAINMENT of a template's shingles is at least _likeness_floor() alike to it, and the number of one-row bands
is chosen so that such a window meets the template in a band with a probability of MISS at most to fail. Each band keeps a window's
least hash. Only windows that meet a template are verified, by the exact share of the template's shingles that they hold.

Null and empty texts match nothing. Texts are scanned where they lie, whole and of any length; nothing is shuffled. Repeated rows give
repeated results; of windows that hold equal shares of a template the first counts. An empty table gives an empty result. Only doc_id and
text are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .textvec import mix64

CONTAINMENT = 0.8
MISS = 1e-5
WIDTH = 5
#: Public licence notices and texts by name, as fixed values.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit-line": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def _likeness_floor() -> float:
    """Least Jaccard likeness of a window of two blocks that holds CONTAINMENT of a template of over half a block."""
    return (CONTAINMENT * 0.5) / (2 + (1 - CONTAINMENT) * 0.5)


def bands_needed(miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - _likeness_floor()))


def shingle_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, text, shingle) in order, of normalised words."""
    import pyarrow.compute as pc

    lowered = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    for at, rows, data, offsets in textvec.slices(lowered):
        starts, ends, first = textvec.word_spans(data, offsets, textvec.PUNCTUATION)
        yield at, rows, *textvec.shingles(textvec.word_hashes(data, starts, ends), first, WIDTH)


class Scanner:
    def __init__(self, templates: dict[str, str], miss: float = MISS):
        self.names = list(templates)
        self.sets = [np.zeros(0, np.uint64) for _ in self.names]
        for at, _, own, values in shingle_runs(pa.array(list(templates.values()))):
            for k in np.unique(own):
                self.sets[at + k] = np.unique(values[own == k])
        self.bands = bands_needed(miss)
        self.classes: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            if len(s):
                self.classes.setdefault(1 << (len(s) - 1).bit_length(), []).append(k)
        # shingles are hashes already; an odd factor deals them anew for each band
        self.seeds = mix64(np.arange(1, self.bands + 1, dtype=np.uint64)) | np.uint64(1)
        self.least = {k: np.array([(self.sets[k] * s).min() for s in self.seeds]) for ks in self.classes.values() for k in ks}

    def scan(self, own: np.ndarray, values: np.ndarray, rows: int) -> list[tuple[int, int, float, int]]:
        """(text, template, containment, first shingle of the window), the best and then first window of each text and template."""
        if not len(values):
            return []
        count = np.bincount(own, minlength=rows)
        first = np.cumsum(count) - count
        cuts, steps, below, blocks, block = {}, [], first, count, 1
        while block <= max(self.classes):  # a block is made of two of the next smaller ones, or of the last one alone
            text, at = np.repeat(np.arange(rows), blocks), np.cumsum(blocks) - blocks
            number = np.arange(int(blocks.sum())) - np.repeat(at, blocks)
            halves = None
            if block > 1:
                begin = np.repeat(below, blocks) + 2 * number
                halves = begin, np.minimum(begin + 1, np.repeat(below + last, blocks))
            cuts[block] = np.repeat(first, blocks) + number * block, text
            steps.append((block, halves, np.arange(len(text)) + (number < np.repeat(blocks - 1, blocks))))
            below, last, blocks, block = at, blocks - 1, (blocks + 1) // 2, 2 * block
        found: set[tuple[int, int, int]] = set()
        for j, seed in enumerate(self.seeds):
            low = values * seed
            for block, halves, after in steps:
                if halves is not None:
                    low = np.minimum(low[halves[0]], low[halves[1]])
                if block in self.classes:
                    pair = np.minimum(low, low[after])
                    for k in self.classes[block]:
                        for w in np.flatnonzero(pair == self.least[k][j]).tolist():
                            found.add((block, k, w))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for block, k, w in sorted(found):
            begin, text = cuts[block]
            t, a = int(text[w]), int(begin[w])
            b = min(a + 2 * block, int(first[t] + count[t]))
            share = float(np.isin(self.sets[k], values[a:b]).sum()) / len(self.sets[k])
            if share >= CONTAINMENT and share > best.get((t, k), (0.0, 0))[0]:
                best[t, k] = share, a - int(first[t])
        return sorted((t, k, share, at) for (t, k), (share, at) in best.items())


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...], miss: float) -> Scanner:
    """One for each Python worker."""
    return Scanner(dict(templates), miss)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, miss: float = MISS) -> DataFrame:
    """doc_id, license, containment, first_shingle: one row for each text and template it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(tuple(templates.items()), miss)
        for batch in batches:
            for at, rows, own, values in shingle_runs(batch.column(1)):
                hits = scanner.scan(own, values, rows)
                ids = batch.column(0).take(pa.array([at + t for t, *_ in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([scanner.names[k] for _, k, _, _ in hits], pa.string()), pa.array([x for *_, x, _ in hits], pa.float64()), pa.array([x for *_, x in hits], pa.int64())],
                    names=["doc_id", "license", "containment", "first_shingle"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(textvec.freeing(run), "doc_id long, license string, containment double, first_shingle long")
