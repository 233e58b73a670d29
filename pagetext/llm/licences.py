"""Licence scans: windows of consecutive normalised words against licence templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wordings of public licences, whole where they are short, and of the usual notices of all of them.
# One licence a block: its name, then its wording.
_WORDINGS = """
Apache-2.0
Licensed under the Apache License, Version 2.0.

Apache-2.0
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.

MIT
Released under the MIT License.

MIT
Licensed under the MIT License.

MIT
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

ISC
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.

BSD-2-Clause
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.

BSD-3-Clause
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.

BSD-3-Clause
Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.

GPL-3.0
This work is licensed under the GNU General Public License, version 3.

GPL-3.0
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.

GPL-2.0
This work is licensed under the GNU General Public License, version 2.

GPL-2.0
This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.

AGPL-3.0
This work is licensed under the GNU Affero General Public License, version 3.

LGPL-3.0
This work is licensed under the GNU Lesser General Public License, version 3.

LGPL-2.1
This work is licensed under the GNU Lesser General Public License, version 2.1.

MPL-2.0
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.

CC-BY-4.0
Licensed under CC BY 4.0.

CC-BY-4.0
This work is licensed under a Creative Commons Attribution 4.0 International License.

CC-BY-SA-4.0
Licensed under CC BY-SA 4.0.

CC-BY-SA-4.0
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.

CC-BY-NC-4.0
Licensed under CC BY-NC 4.0.

CC-BY-NC-4.0
This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.

CC-BY-ND-4.0
Licensed under CC BY-ND 4.0.

CC-BY-NC-SA-4.0
Licensed under CC BY-NC-SA 4.0.

CC-BY-NC-ND-4.0
Licensed under CC BY-NC-ND 4.0.

CC0-1.0
To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.

Unlicense
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for
the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
TEMPLATES: tuple[tuple[str, str], ...] = tuple((name, " ".join(text.split())) for name, text in (b.split("\n", 1) for b in _WORDINGS.strip().split("\n\n")))

_WORD = re.compile(rb"[a-z0-9]+")
_TEXT_WORD = re.compile("[A-Za-z0-9]+")
PIECE = 1 << 20  # bytes of a text cut into words at a time
GROUP = 1 << 19  # words of several texts looked at together


def normal_words(text: bytes) -> list[bytes]:
    """Words of ASCII letters and digits, A-Z in lower case; everything else separates."""
    return _WORD.findall(text.lower())


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, no word cut in two."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and text[end:end + 1].isalnum():
            end += 1
        yield text[start:end]
        start = end


class _Template:
    """One template of m bigrams: how often each stands in it, the fewest shared bigrams and the longest window a match can have."""

    def __init__(self, name: str, rank: int, codes: np.ndarray, known: np.ndarray, least: float):
        self.name, self.rank, self.m = name, rank, len(codes)
        self.times = np.bincount(np.searchsorted(known, codes), minlength=len(known))
        self.low = math.ceil(self.m * least / (2 - least) - 1e-9)
        self.high = math.floor(self.m * (2 - least) / least + 1e-9)


class _Shared:
    """Places of a group of texts whose bigram stands in the template, and where a window may start."""

    def __init__(self, t: _Template, places: np.ndarray, kinds: np.ndarray, ends: np.ndarray):
        mine = t.times[kinds] > 0
        self.t, self.at, self.ends = t, places[mine], ends[mine]
        reach = np.searchsorted(self.at, np.minimum(self.at + t.high, self.ends))
        self.starts = np.flatnonzero(reach - np.arange(len(self.at)) >= t.low)  # size bounds: no other place can start a match
        if len(self.starts):
            kind = kinds[mine]
            order = np.argsort(kind, kind="stable")
            run = kind[order]
            back = np.arange(len(run)) - t.times[run]
            same = (back >= 0) & (run[np.maximum(back, 0)] == run)
            self.spent = np.full(len(run), -1, np.int64)  # from this place on a further copy of the bigram is one too many
            self.spent[order[same]] = self.at[order[back[same]]]

    def best(self, i: int, limit: int, least: float) -> tuple[float, int, int] | None:
        """(score, last bigram, shared bigrams) of the best window from shared place i that ends before ``limit``."""
        a = self.at[i]
        j = np.searchsorted(self.at, min(a + self.t.high, self.ends[i], limit))
        if j - i < self.t.low:
            return None
        shared = np.cumsum(self.spent[i:j] < a)
        total = self.at[i:j] - a + 1 + self.t.m
        score = np.where(2.0 * shared / total >= least, shared * shared / total, -1.0)
        k = int(np.argmax(score))
        return (float(score[k]), int(self.at[i + k]), int(shared[k])) if score[k] > 0 else None


class Matcher:
    """Finds the windows of texts that match a template; only windows whose size allows the least coefficient are compared."""

    def __init__(self, templates=TEMPLATES, least: float = 0.8):
        self.least = least
        words = [(name, w) for name, text in templates if len(w := normal_words(text.encode())) > 1]
        self.vocab = {w: k for k, w in enumerate(sorted({w for _, ws in words for w in ws}))}
        self.width = np.int64(len(self.vocab))
        coded = [(name, self._codes(np.array([self.vocab[w] for w in ws], np.int64))) for name, ws in words]
        self.known = np.unique(np.concatenate([c for _, c in coded])) if coded else np.zeros(0, np.int64)
        self.templates = [_Template(name, k, codes, self.known, least) for k, (name, codes) in enumerate(coded)]

    def _codes(self, ids: np.ndarray) -> np.ndarray:
        return np.where((ids[:-1] < 0) | (ids[1:] < 0), -1, ids[:-1] * self.width + ids[1:])

    def _ids(self, text: bytes) -> list[np.ndarray]:
        get = self.vocab.get
        return [np.fromiter((get(w, -1) for w in normal_words(p)), np.int64) for p in _pieces(text)]

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, str, int, int, float, int]]:
        """(number of the text, licence, first word, words, dice, shared bigrams) of all matches, text by text in order of their places."""
        if not self.templates:
            return
        parts, sizes, first = [], [], 0
        for n, text in enumerate(texts):
            ids = self._ids(text)
            parts += [*ids, np.full(1, -1, np.int64)]
            sizes.append(sum(map(len, ids)) + 1)
            if sum(sizes) >= GROUP or n + 1 == len(texts):
                yield from self._group(np.concatenate(parts), np.cumsum(sizes), first)
                parts, sizes, first = [], [], n + 1

    def _group(self, ids: np.ndarray, stops: np.ndarray, first: int) -> Iterator[tuple[int, str, int, int, float, int]]:
        codes = self._codes(ids)
        places = np.flatnonzero(codes >= 0)
        kinds = np.searchsorted(self.known, codes[places])
        there = self.known[np.minimum(kinds, len(self.known) - 1)] == codes[places]
        places, kinds = places[there], kinds[there]
        ends = stops[np.searchsorted(stops, places, side="right")]
        heap = []
        shared = [_Shared(t, places, kinds, ends) for t in self.templates]
        for s in shared:
            heap += [(-b[0], int(s.at[i]), b[1], s.t.name, s.t.rank, i, b[2]) for i in s.starts.tolist() if (b := s.best(i, len(ids), self.least))]
        heapq.heapify(heap)
        taken: list[tuple[int, int, str, float, int]] = []
        while heap:
            _, a, b, name, rank, i, n = heapq.heappop(heap)
            k = bisect_right(taken, (a, len(ids)))
            if k and taken[k - 1][1] >= a:
                continue
            if k < len(taken) and taken[k][0] <= b + 1:  # reaches into a better window: what ends before it is still free
                if again := shared[rank].best(i, taken[k][0] - 1, self.least):
                    heapq.heappush(heap, (-again[0], a, again[1], name, rank, i, again[2]))
                continue
            insort(taken, (a, b + 1, name, 2.0 * n / (b - a + 1 + self.templates[rank].m), n))
        for a, z, name, dice, n in taken:
            d = int(np.searchsorted(stops, a, side="right"))
            yield first + d, name, a - (int(stops[d - 1]) if d else 0), z - a + 1, dice, n


def _spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points [start, end) of windows given by first word and words, in order of their places."""
    found, words, seen = [], _TEXT_WORD.finditer(text), 0
    for first, n in hits:
        m = next(islice(words, first - seen, None))
        last = next(islice(words, n - 2, None))
        found.append((m.start(), last.end()))
        seen = first + n
    return found


def scan_licences(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Places of every whole text that match a template: doc_id, license, first_word (from 0), n_words, start, end, dice, n_shared.

    Texts become sequences of normalised words (ASCII letters and digits, A-Z in lower case), so line ends, blank lines, comment
    signs and punctuation do not matter. A window is any stretch of words that begins and ends with a bigram of the template;
    n_shared counts its bigrams that stand in the template, each as often as there at most, and dice is twice that over the
    bigrams of both. Windows of dice ``least`` or more compete by n_shared * dice (ties: first start, then end, name and place in
    ``templates``); the best is taken, then the best of those that share no word with it, and so on. ``start`` and ``end`` are
    code points, end exclusive. A template of fewer than two words matches nothing, as do null, empty and one-word texts.
    Repeated rows are scanned each; further columns are ignored. Whole long licences can be given as ``templates``.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(templates, least)
        names = ["doc_id", "license", "first_word", "n_words", "start", "end", "dice", "n_shared"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        for b in batches:
            texts = [(t.as_py() or "") for t in b.column(1)]
            hits: dict[int, list[tuple]] = {}
            for n, *hit in m.scan([t.encode("utf-8", "surrogatepass") for t in texts]):
                hits.setdefault(n, []).append(hit)
            rows = [(n, *h[:3], *span, *h[3:]) for n, found in hits.items() for h, span in zip(found, _spans(texts[n], [h[1:3] for h in found]))]
            cols = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(x, k) for x, k in zip(cols[1:], kinds))], names=names)

    kept = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kept}, license string, first_word bigint, n_words bigint, start bigint, end bigint, dice double, n_shared bigint")


def licence_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8) -> str:
    """DuckDB twin of ``scan_licences`` without its code points, over the view ``documents``."""
    rows = ", ".join(f"({k}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for k, (n, t) in enumerate(templates))
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    words = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
    high = f"floor(m * {2 - least} / {least} + 1e-9)::bigint"
    return f"""with recursive t as (select k, n, len(w) - 1 as m, unnest({pairs}) as bigram from (select k, n, {words.format('x')} as w from (values {rows}) v(k, n, x)) where len(w) > 1),
tb as (select k, n, m, bigram, count(*) as c from t group by all),
d as (select row_number() over () as r, doc_id, {words.format('text')} as w from documents),
g as (select r, unnest(range(0, len(w) - 1)) as i, unnest({pairs}) as bigram from d where len(w) > 1),
a as (select r, k, n, m, i, lag(i, c) over (partition by r, k, bigram order by i) as spent,
 count(*) over (partition by r, k order by i range between current row and ({high} - 1) following) as near from g join tb using (bigram)),
s as (select r, k, i as a from a where near >= ceil(m * {least} / {2 - least} - 1e-9)),
x as (select r, k, n, s.a, i as b, i - s.a + 1 + m as total, sum((coalesce(spent, -1) < s.a)::int) over (partition by r, k, s.a order by i) as shared
 from s join a using (r, k) where i >= s.a and i < s.a + {high}),
y as (select r, k, n, a, b, shared::bigint as shared, 2.0::double * shared / total as dice, (shared * shared)::double / total as score from x where 2.0::double * shared / total >= {least}),
free as (select *, 0 as step from y union all
 select r, k, n, a, b, shared, dice, score, step + 1 from (select *, first_value(a) over best as top_a, first_value(b) over best as top_b from free
  window best as (partition by r order by score desc, a, b, n, k)) where b + 1 < top_a or a > top_b + 1),
z as (select * from free qualify row_number() over (partition by r, step order by score desc, a, b, n, k) = 1)
select doc_id, n as license, a::bigint as first_word, (b - a + 2)::bigint as n_words, dice, shared as n_shared from z join d using (r)"""
