"""Operator 8: license scan by MinHash bands over overlapping text windows.

Templates are in classes of size (up to 1, 2, 4, ... five-word shingles). A class has
windows of twice its size at a window's half distance over the whole text, so a template
that stands in a text lies whole in one of them, and its similarity to that window is over a
quarter (0.19 when a fifth of the template is changed). Each window's MinHash signature
of ``PERMUTATIONS`` bands of one row is looked up in a table of the templates' bands: they
meet with a probability of 1 - (1 - similarity) ^ 48, over 0.9999 at 0.19. A
template that is retrieved so is verified by exact containment of its shingles in the
window (0.8 or more). Nothing else leads to a template. Signatures cost little, as
the minima of windows are those of their halves, class by class. Overlapping or adjoining finds of
a license are one, and of overlapping finds of several the fullest, then largest, stay.

Null, empty and short texts hold nothing; a null doc_id is reported as such; repeated
rows are each reported; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import caches, common, shingles

CONTAINMENT = 0.8
PERMUTATIONS = 48
#: Shingles whose windows are signed together; bits of the table in front of the bands' search.
STEP, BUCKET_BITS = 4096, 16

#: The wording of public licenses and of their notices, without names and years.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "gpl-3.0": (
        "licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "gpl-2.0": (
        "licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "lgpl": (
        "licensed under the GNU Lesser General Public License",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "agpl-3.0": (
        "licensed under the GNU Affero General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "bsd": (
        "licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "bsd-2-clause": (
        "licensed under the BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "bsl-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "cc-by-4.0": ("Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related rights",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
}


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.intp)


class Scanner:
    """Templates' bands, and the look-up of windows in them."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, permutations: int = PERMUTATIONS):
        draw = np.random.default_rng(11).integers(0, 1 << 63, (3, permutations, 1), dtype=np.uint64)
        self.flip, self.factor, self.number = draw[0], draw[1] | np.uint64(1), draw[2]
        self.names = [(name, text) for name, texts in templates.items() for text in texts]
        self.sets = [shingles.distinct(text) for _, text in self.names]
        #: For each class of size (1, 2, 4, ... shingles): its templates, and a table of their bands.
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            by_size.setdefault(1 << (max(len(s), 1) - 1).bit_length(), []).append(k)
        for size, ks in by_size.items():
            bands = np.concatenate([self._bands(self._permuted(self.sets[k]).min(axis=1, keepdims=True))[:, 0] for k in ks])
            order = np.argsort(bands)
            buckets = np.zeros(1 << BUCKET_BITS, bool)
            buckets[_bucket(bands)] = True
            self.classes[size] = (buckets, bands[order], np.repeat(ks, permutations)[order], np.array(ks))
        self.largest = max(self.classes)

    def _permuted(self, x: np.ndarray) -> np.ndarray:
        return (x[None, :] ^ self.flip) * self.factor

    def _bands(self, minima: np.ndarray) -> np.ndarray:
        """One key for each band of one row, its number mixed in."""
        return minima ^ self.number

    def retrieved(self, seq: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first shingle, end) of the windows that share a band with the template."""
        out: set[tuple[int, int, int]] = set()
        step = max(STEP, self.largest)
        for at in range(0, len(seq), step):
            # a step's windows start in it and may end in the next one
            piece = seq[at : at + step + self.largest]
            low, size = self._permuted(piece), 1
            while True:
                if size in self.classes:
                    ends = np.minimum(low[:, :-1], low[:, 1:]) if low.shape[1] > 1 else low
                    out |= {(k, at + w * size, at + (w + 2) * size) for k, w in self._looked_up(size, self._bands(ends)) if w * size < step}
                if size == self.largest:
                    break
                size *= 2
                if low.shape[1] % 2:
                    low = np.concatenate((low, np.full((len(low), 1), np.iinfo(np.uint64).max, np.uint64)), axis=1)
                low = np.minimum(low[:, ::2], low[:, 1::2])
        return out

    def _looked_up(self, size: int, keys: np.ndarray) -> set[tuple[int, int]]:
        buckets, bands, owners, _ = self.classes[size]
        window = np.flatnonzero(buckets[_bucket(keys)].ravel())
        if not len(window):
            return set()
        met, window = keys.ravel()[window], window % keys.shape[1]
        first, last = np.searchsorted(bands, met), np.searchsorted(bands, met, side="right")
        return {(int(owners[k]), int(w)) for a, b, w in zip(first, last, window, strict=True) for k in range(a, b)}

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, containment, first word, end word), words numbered from 0."""
        h = shingles.word_hashes(text)
        if len(h) < shingles.SIZE:
            return []
        seq = shingles.sequence(h)
        found = []
        for k, start, end in sorted(self.retrieved(seq)):
            window, template = seq[start:end], self.sets[k]
            held = np.isin(window, template)
            share = len(np.unique(window[held])) / len(template)
            if share >= CONTAINMENT:
                places = start + np.flatnonzero(held)
                found.append((self.names[k][0], share, int(places[0]), int(places[-1]) + shingles.SIZE, len(template)))
        # of finds that overlap, those that another license's fuller one, or as full and larger one, beats go
        beats = lambda y, x: (y[1], y[4]) > (x[1], x[4]) and y[0] != x[0] and y[2] < x[3] and x[2] < y[3]
        found = [x for x in found if not any(beats(y, x) for y in found)]
        out: list[tuple[str, float, int, int]] = []
        for name, share, a, b, _ in sorted(found, key=lambda x: (x[0], x[2])):
            if out and out[-1][0] == name and a <= out[-1][3]:
                last = out[-1]
                out[-1] = (name, max(share, last[1]), last[2], max(b, last[3]))
            else:
                out.append((name, share, a, b))
        return out


_scanner: list[Scanner] = []


def _scan(batches):
    caches.only("shingles")
    if not _scanner:
        _scanner.append(Scanner())
    for b in batches:
        rows = [(d, *x) for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in _scanner[0].scan(text)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "license", "containment", "first_word", "end_word"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, license, containment, first_word, end_word of every license found. No shuffle."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, license string, containment double, first_word long, end_word long")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the licenses in every document."""
    return scan(common.table(spark, sf_dir, "documents"))
