"""License scans by conditional compression.

Candidate blocks are the words around a template's intact pieces: a stretch within
the allowed number of word edits of a template keeps one of its edits + 1 pieces
word by word, so an automaton over all pieces loses no notice. Where stretches within
the allowed edits of several templates overlap, their words are one candidate block: it
is compressed with each of these templates as a raw zstandard dictionary, and the
templates are ranked by the reduction of its size. The first one's stretches are the
notices there, confirmed by the words in which they and it differ; a later one's count
where they leave room. These are cut out and the remainders looked at again until none is left.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Openings that several wordings share.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"),"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,"
_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,"
#: Usual wordings of license notices, with the public SPDX names.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("MIT", _GRANT + " to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + " FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", _TERMS + " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("BSD-3-Clause", _TERMS + " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", _GPL + " either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", _GPL + " either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]
#: The share of a template's words that may differ.
MAX_DIFFERENCE = 0.15

_WORD = re.compile(r"[0-9a-z]+(?:[.\-+][0-9a-z]+)*", re.I | re.A)
#: Letters and digits stay (A-Z become a-z), all other bytes become a space: words as above are one or more of these.
_COARSE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_HITS = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("license", T.StringType()),
            T.StructField("reduction", T.DoubleType()),
            T.StructField("n_different", T.IntegerType()),
        ]
    )
)
_HITS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("reduction", pa.float64()), ("n_different", pa.int32())]))


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def coarse(text: str) -> str:
    """The text's runs of letters and digits between spaces: a quick form in which no piece of a template gets lost."""
    return f" {b' '.join(text.encode().translate(_COARSE).split()).decode()} "


def window_ends(block: list[str], template: list[str]) -> tuple[list[int], list[int]]:
    """For each end word, the fewest word edits of a stretch that ends there to ``template``, and that stretch's first word."""
    n = len(template)
    cost, start = [0] * (len(block) + 1), list(range(len(block) + 1))
    for i in range(1, n + 1):
        before, before_start = cost, start
        cost, start = [i] + [0] * len(block), [0] * (len(block) + 1)
        for j in range(1, len(block) + 1):
            change = before[j - 1] + (block[j - 1] != template[i - 1])
            drop, add = before[j] + 1, cost[j - 1] + 1
            least = min(change, drop, add)
            cost[j] = least
            start[j] = before_start[j - 1] if least == change else before_start[j] if least == drop else start[j - 1]
    return cost, start


def best_window(block: list[str], template: list[str]) -> tuple[int, int, int]:
    """(differences, first word, end word) of the stretch of ``block`` with the fewest word edits to ``template``."""
    cost, start = window_ends(block, template)
    end = min(range(len(block) + 1), key=lambda j: (cost[j], j))
    return cost[end], start[end], end


def near_windows(block: list[str], template: list[str], vocabulary: set[str]) -> list[tuple[int, int, int]]:
    """(differences, first word, end word) of a stretch for each end word that has one within ``MAX_DIFFERENCE``.

    Such a stretch has at most ``most`` words more than the template, and all but
    ``most`` of the template's words: edits are counted only where words are that dense.
    """
    n = len(template)
    most = int(MAX_DIFFERENCE * n)
    at = [i for i, w in enumerate(block) if w in vocabulary]
    regions: list[list[int]] = []
    for first, last in zip(at, at[n - most - 1 :]):
        if last - first >= n + most:
            continue
        a, b = max(0, first - 2 * most), min(len(block), first + n + 2 * most)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    out = []
    for a, b in regions:
        cost, start = window_ends(block[a:b], template)
        out += [(c, a + start[j], a + j) for j, c in enumerate(cost) if c <= most and j > start[j]]
    return out


class Scanner:
    """Compressors for each template, made once per task."""

    def __init__(self, templates=None):
        templates = templates or TEMPLATES
        self.names = [name for name, _ in templates]
        self.texts = [words(text) for _, text in templates]
        self.vocabularies = [set(t) for t in self.texts]
        self.pieces, self.quick = self._automata()
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.given = [
            zstandard.ZstdCompressor(
                level=3, write_content_size=False, write_dict_id=False,
                dict_data=zstandard.ZstdCompressionDict(" ".join(t).encode().ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            )
            for t in self.texts
        ]

    def _automata(self):
        """Each template cut in as many pieces as it may have edits, and one more: (template, first word of the piece); and the pieces in coarse form."""
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.texts):
            n = int(MAX_DIFFERENCE * len(t)) + 1
            for i in range(n):
                a, b = i * len(t) // n, (i + 1) * len(t) // n
                pieces.setdefault(f" {' '.join(t[a:b])} ", []).append((k, a))
        found, quick = ahocorasick.Automaton(), ahocorasick.Automaton()
        for piece, at in pieces.items():
            found.add_word(piece, (len(piece), at))
            quick.add_word(coarse(piece), True)
        found.make_automaton()
        quick.make_automaton()
        return found, quick

    def stretches(self, own: list[str], templates: set[int] | None = None) -> list[tuple[int, int, str, float, int]]:
        """(first word, end word, license, reduction, differences) of the block's confirmed stretches, none of which overlap."""
        templates = set(range(len(self.texts))) if templates is None else templates
        found, left = [], [(0, len(own))]
        while left:
            a, b = left.pop()
            cut = [x for block in self._candidates(own[a:b], templates) for x in self._confirmed(own[a:b], block)]
            if not cut:
                continue
            found += [(a + i, a + j, *rest) for i, j, *rest in sorted(cut)]
            ends = [0, *(x for i, j, *_ in sorted(cut) for x in (i, j)), b - a]
            left += [(a + i, a + j) for i, j in zip(ends[::2], ends[1::2]) if j > i]
        return sorted(found)

    def _candidates(self, own: list[str], templates: set[int]) -> list[list[tuple[int, int, int, int]]]:
        """Candidate blocks: (first word, end word, template, differences) of stretches near a template, those that overlap together.

        Of stretches of one template that overlap the nearest counts, then the first to end.
        """
        near = []
        for k in templates:
            taken = bytearray(len(own))
            for d, i, j in sorted(near_windows(own, self.texts[k], self.vocabularies[k]), key=lambda w: (w[0], w[2])):
                if 1 not in taken[i:j]:
                    taken[i:j] = b"\1" * (j - i)
                    near.append((i, j, k, d))
        blocks: list[list[tuple[int, int, int, int]]] = []
        reach = -1
        for stretch in sorted(near):
            if stretch[0] < reach:
                blocks[-1].append(stretch)
            else:
                blocks.append([stretch])
            reach = max(reach, stretch[1])
        return blocks

    def size(self, own: list[str], template: int) -> int:
        """Bytes of the words compressed with a template as dictionary."""
        return len(self.given[template].compress(" ".join(own).encode()))

    def _confirmed(self, own: list[str], block: list[tuple[int, int, int, int]]) -> list[tuple[int, int, str, float, int]]:
        """The block's notices: templates by their reduction of the block's size, equal ones by differing words, then the longest."""
        first, end = min(i for i, *_ in block), max(j for _, j, *_ in block)
        least = {k: min(d for _, _, x, d in block if x == k) / len(self.texts[k]) for _, _, k, _ in block}
        ranked = sorted(least, key=lambda k: (self.size(own[first:end], k), least[k], -len(self.texts[k]), k))
        taken, out = bytearray(end - first), []
        for k in ranked:
            for i, j, _, d in sorted((x for x in block if x[2] == k), key=lambda x: (x[3], x[1])):
                if 1 in taken[i - first : j - first]:
                    continue
                taken[i - first : j - first] = b"\1" * (j - i)
                plain = len(self.plain.compress(" ".join(own[i:j]).encode()))
                out.append((i, j, self.names[k], 1 - self.size(own[i:j], k) / plain, d))
        return out

    def scan(self, text: str) -> list[dict]:
        if next(self.quick.iter(coarse(text)), None) is None:
            return []
        own = words(text)
        line = f" {' '.join(own)} "
        hits = [(end, size, at) for end, (size, at) in self.pieces.iter(line)]
        if not hits:
            return []
        starts = array("q", (m.start() for m in _WORD.finditer(text)))
        ends = array("q", (m.end() for m in _WORD.finditer(text)))
        out = []
        for first, last, templates in self._blocks(own, hits):
            for a, b, name, gain, differences in self.stretches(own[first:last], templates):
                out.append({"start": starts[first + a], "end": ends[first + b - 1], "license": name, "reduction": round(gain, 6), "n_different": differences})
        return out

    def _blocks(self, own: list[str], hits: list[tuple[int, int, list[tuple[int, int]]]]) -> list[tuple[int, int, set[int]]]:
        """(first word, end word, templates) of where stretches around pieces may reach; those that touch are one."""
        place = array("q", [0])  # of each word in the line
        for w in own:
            place.append(place[-1] + len(w) + 1)
        spans = []
        for end, size, at in hits:
            i = bisect_right(place, end - size + 1) - 1
            for k, offset in at:
                n = len(self.texts[k])
                most = int(MAX_DIFFERENCE * n)
                spans.append((max(0, i - offset - most), min(len(own), i - offset + n + 2 * most), k))
        out: list[tuple[int, int, set[int]]] = []
        for a, b, k in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2] | {k})
            else:
                out.append((a, b, {k}))
        return out


def find_licenses(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``licenses``: start and end (code points), license, size reduction and differing words of each notice.

    Null and empty texts have none; a column ``licenses`` is replaced; repeated
    rows are scanned alike; texts of any length are scanned whole, word by word, so
    line breaks, white space and comment marks within a notice don't count. An empty
    table gives no rows. Of templates within ``MAX_DIFFERENCE`` of overlapping stretches the
    one that compresses them best is named; if several do so alike, the one with the
    smaller share of differing words, then the longest.
    """
    from .common import append_columns

    def make():
        scanner = Scanner()

        def work(texts):
            return [pa.array([scanner.scan(t) if t else [] for t in texts.to_pylist()], _HITS_ARROW)]

        return work

    return append_columns(docs, [text_col], [T.StructField("licenses", _HITS)], make)


def license_report(docs: DataFrame) -> DataFrame:
    """One row per notice: doc_id, start, end, license, reduction, n_different, notice.

    Null and empty texts give none, repeated rows give theirs each time; other columns do not pass.
    """
    found = find_licenses(docs.select("doc_id", "text")).where(F.size("licenses") > 0)
    return found.select("doc_id", "text", F.explode("licenses").alias("x")).select(
        "doc_id", "x.*", F.expr("substring(text, x.start + 1, x.end - x.start)").alias("notice")
    )
