"""Licence texts in documents, by patience alignment with templates.

Texts and templates are taken as words (runs of letters and digits, lower-cased).
A template is aligned with a stretch of a document like this: what agrees at both
ends is matched; of the rest, words that occur once in both are anchors; the
longest increasing sequence of anchors is matched, and the gaps between them are
aligned in the same way. The share of the template's words that are matched is
its coverage; ``LEAST`` and more is reported. Notices and licences that differ in a
few words only are told apart by the phrases in ``NEEDED``: each must be matched
without a gap at one of its places in the template.

Which stretches are aligned follows from counts and loses nothing above the
threshold within a stretch of ``WIDE`` template lengths: the words of a document
that occur in the template at all, each as often as there at most, must be enough
for the coverage, in the whole document first and then in a sliding window. So
nearly all documents are passed by without an alignment. Of the windows of a long
template, those that begin within a 200th of its length are aligned as one, wider
by that much. Documents are taken
whole and are not shuffled; the templates are a fixed small list.

Null and empty texts hold nothing; a licence that a document holds more than once
is reported for each place that does not overlap a better one; repeated rows are
reported each; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import bisect
import pkgutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplemill.llm.common import LOWER, blocks, word_hashes, word_spans

LEAST = 0.8
WIDE = 1.5

# Public notices and licence texts.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
    "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "all-rights-reserved-notice": "All rights reserved.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU General Public License for more details.""",
    "GPL-2.0-header": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 2 of the License, or
(at your option) any later version.
This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU General Public License for more details.""",
    "AGPL-3.0-header": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU Affero General Public License for more details.""",
    "LGPL-3.0-header": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU Lesser General Public License for more details.""",
    "LGPL-2.1-header": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 2.1 of the License, or
(at your option) any later version.
This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU Lesser General Public License for more details.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
}
# Whole texts, from the files beside this one.
WHOLE = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"]
TEMPLATES |= {
    name: pkgutil.get_data(__name__, f"license_texts/{name}.txt").decode() for name in WHOLE
}

# Phrases that tell a template from those like it.
NEEDED = {
    "Apache-2.0-notice": ["apache", "version 2 0"],
    "Apache-2.0-header": ["apache", "version 2 0"],
    "MIT-notice": ["mit"],
    "MPL-2.0-notice": ["mozilla public license", "2 0"],
    "MPL-2.0-header": ["mozilla public license", "2 0"],
    "BSD-2-Clause-notice": ["bsd 2 clause"],
    "BSD-3-Clause-notice": ["bsd 3 clause"],
    "BSD-2-Clause": ["provided with the distribution this software"],
    "BSD-3-Clause": ["endorse or promote products"],
    "GPL-3.0": ["use with the gnu affero general public license"],
    **{f"CC-{c}-4.0-notice": [f"cc {c} 4 0"] for c in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")},
    **{
        f"{name}-{form}": [f"gnu {kind}general public license", f"version {version}"]
        for form in ("notice", "header")
        for name, kind, version in (
            ("GPL-2.0", "", "2"),
            ("GPL-3.0", "", "3"),
            ("LGPL-2.1", "lesser ", "2 1"),
            ("LGPL-3.0", "lesser ", "3"),
            ("AGPL-3.0", "affero ", "3"),
        )
    },
}

NO_WORD = np.ones(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    NO_WORD[_low:_high] = False


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing sequence."""
    ends: list[int] = []
    end_at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect.bisect_left(ends, v)
        before[i] = end_at[k - 1] if k else -1
        if k == len(ends):
            ends.append(v)
            end_at.append(i)
        else:
            ends[k], end_at[k] = v, i
    out, i = [], end_at[-1] if end_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions of ``a`` and ``b`` that patience alignment matches."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        once_a = _once(a, i, i_end)
        once_b = _once(b, j, j_end)
        pairs = [(p, once_b[w]) for w, p in once_a.items() if w in once_b]
        anchors = [pairs[k] for k in increasing([q for _, q in pairs])]
        if not anchors:
            continue
        out += anchors
        for p, q in [*anchors, (i_end, j_end)]:
            todo.append((i, p, j, q))
            i, j = p + 1, q + 1
    return sorted(out)


def _once(words: list[int], low: int, high: int) -> dict[int, int]:
    """Position of each word that occurs once, in order of position."""
    seen: dict[int, int] = {}
    for p in range(low, high):
        seen[words[p]] = -1 if words[p] in seen else p
    return {w: p for w, p in seen.items() if p >= 0}


def _hashes(text: str) -> np.ndarray:
    raw = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return word_hashes(raw, *word_spans(raw, np.array([0, len(raw)]), NO_WORD))


def _places(words: np.ndarray, phrase: np.ndarray) -> list[tuple[int, int]]:
    n = len(phrase)
    return [(i, i + n) for i in range(len(words) - n + 1) if (words[i : i + n] == phrase).all()]


class Templates:
    """Templates over one list of their words."""

    def __init__(self, texts: dict[str, str], least: float):
        self.names = list(texts)
        hashes = [_hashes(text) for text in texts.values()]
        self.words = np.unique(np.concatenate(hashes))
        self.lists = [np.searchsorted(self.words, h) for h in hashes]
        self.counts = np.stack([np.bincount(x, minlength=len(self.words)) for x in self.lists])
        self.need = [int(np.ceil(least * len(x) - 1e-9)) for x in self.lists]
        # Places of each needed phrase, as ranges of template words.
        self.phrases = [
            [_places(h, _hashes(phrase)) for phrase in NEEDED.get(name, [])]
            for name, h in zip(self.names, hashes, strict=True)
        ]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the templates, or -1."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def found(self, words: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Template, matched words, begin and end, of each licence of a text."""
        known = words[words >= 0]
        enough = np.minimum(np.bincount(known, minlength=len(self.words)), self.counts)
        for t in np.flatnonzero(enough.sum(axis=1) >= self.need):
            yield from self.places(int(t), words)

    def rich(self, t: int, words: np.ndarray, wide: int) -> list[int]:
        """Where stretches of ``wide`` words begin that hold enough of the
        template's words, each at most as often as the template has it. A
        stretch begins with such a word."""
        have, limit = [0] * len(self.words), self.counts[t].tolist()
        at = np.flatnonzero(np.concatenate([self.counts[t] > 0, [False]])[words]).tolist()
        own = words[at].tolist()
        out, total, end = [], 0, 0
        for begin, (place, word) in enumerate(zip(at, own, strict=True)):
            while end < len(at) and at[end] < place + wide:
                w = own[end]
                total += have[w] < limit[w]
                have[w] += 1
                end += 1
            if total >= self.need[t]:
                out.append(at[begin])
            have[word] -= 1
            total -= have[word] < limit[word]
        return out

    def has_phrases(self, t: int, pairs: list[tuple[int, int]]) -> bool:
        """Whether each needed phrase is matched without a gap at one of its places."""
        met = {j: i for i, j in pairs}
        return all(
            any(
                low in met and all(met.get(j) == met[low] + j - low for j in range(low, high))
                for low, high in phrase
            )
            for phrase in self.phrases[t]
        )

    def places(self, t: int, words: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        template, need = self.lists[t], self.need[t]
        wide = int(np.ceil(len(template) * WIDE))
        step, last = max(1, len(template) // 200), -len(words) - wide
        best, own = [], template.tolist()
        for begin in self.rich(t, words, wide):
            if begin < last + step:
                continue
            last = begin
            pairs = aligned(words[begin : begin + wide + step - 1].tolist(), own)
            if len(pairs) >= need and self.has_phrases(t, pairs):
                best.append((-len(pairs), begin + pairs[0][0], begin + pairs[-1][0] + 1))
        taken: list[tuple[int, int]] = []
        for n, low, high in sorted(set(best)):
            if all(high <= a or b <= low for a, b in taken):
                taken.append((low, high))
                yield t, -n, low, high


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates: dict[str, str] = TEMPLATES,
    least: float = LEAST,
) -> DataFrame:
    """One row per licence and place: key, license, coverage, first_word and
    last_word (exclusive), counted in words of letters and digits."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def search(batches):
        known = Templates(templates, least)
        for part, raw, at in blocks(batches, "text"):
            low = LOWER[raw]
            first, end = word_spans(low, at, NO_WORD)
            numbers, begin = known.numbers(word_hashes(low, first, end)), np.searchsorted(first, at)
            met = [
                (d, *m)
                for d in range(part.num_rows)
                for m in known.found(numbers[begin[d] : begin[d + 1]])
            ]
            if met:
                d, t, n, a, b = zip(*met, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(d)),
                        pa.array([known.names[i] for i in t]),
                        pa.array([k / len(known.lists[i]) for k, i in zip(n, t, strict=True)]),
                        pa.array(a, pa.int64()),
                        pa.array(b, pa.int64()),
                    ],
                    names=["key", "license", "coverage", "first_word", "last_word"],
                )

    schema = f"key {kind}, license string, coverage double, first_word bigint, last_word bigint"
    return rows.mapInArrow(search, schema).withColumnRenamed("key", key)
