"""Licence scans: passages of texts against licence templates by Dice coefficient.

A passage is any run of a text's words, whatever lines, paragraphs and sentences it
crosses. Passages and templates are normalised to words (letters and digits in lower
case, spellings of licence alike, copyright clauses left out) and compared by the Dice
coefficient of their word bigrams, repeats included.

All runs count, but few are looked at, and no bound loses any. With a threshold t, a
passage of size a can reach t against a template of size b only if they share
b * t / (2 - t) bigrams, which is asked of the whole text first. The best passage begins
and ends with a bigram of the template, as any other end only adds to its size. A start
is followed up only if the template's bigrams behind it are dense enough somewhere, and
no further than a * t = b * (2 - t).

Of passages that overlap, the one with most shared bigrams times its coefficient stays:
a whole notice rather than the short one inside it, and the template that fits better.
The words between those that stay are searched again.

Each row is worked on by itself, in Arrow batches; nothing is shuffled.

Rows: null and empty texts have no licence; texts of any length are searched whole.
Repeated rows, null ids and further columns of any name make no difference. Between
templates that score alike, the first by name is taken, and of passages that weigh alike
the first by template and place. No rows give no rows; without templates nothing is found.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import license_texts
from gridloom.llm.common import slices

_WORD = re.compile(r"[a-z0-9]+")
_LICENCE = re.compile(r"(?<![a-z0-9])licence")
#: From a mark at the beginning of a line to the end of the sentence or line, or to words that a notice begins with.
_COPYRIGHT = re.compile(
    r"^[ \t#*/;%|-]*+(?:copyright|\(c\)|©)(?![ \t]+(?:holders?|owners?|notices?|laws?|statements?|disclaimers?|and|or)\b)"
    r"(?:(?!\b(?:licen[cs]ed|released|distributed|permission|redistribution|spdx|this (?:program|work|file|software|source|is))\b)(?:[^\n.]|\.(?!\s|$)))*+\.?",
    re.M,
)
#: Pairs of starts and ends that are compared at a time.
BLOCK = 200_000


def _lowered(text: str) -> str:
    """The text in lower case without copyright clauses, each character in its place."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower()[0] for c in text)
    if "copyright" in low or "(c)" in low or "©" in low:
        low = _COPYRIGHT.sub(lambda m: " " * len(m[0]), low)
    return _LICENCE.sub("license", low) if "licence" in low else low


class Template(NamedTuple):
    name: str
    bigrams: Counter
    size: int


class Found(NamedTuple):
    start: int
    end: int
    name: str
    dice: float


class Window(NamedTuple):
    """Words from first to last, and a template that they are like."""

    weight: float
    name: str
    first: int
    last: int
    dice: float


class Scanner:
    """Templates sorted by size, and the bigrams that any of them has."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float) -> None:
        if not 0 < threshold <= 1:
            raise ValueError("the threshold is above 0 and 1 at most")
        self.threshold = threshold
        made = []
        for name, text in templates:
            grams = Counter(self._grams(self._words(text)))
            made.append(Template(name, grams, sum(grams.values())))
        self.templates = sorted((t for t in made if t.size), key=lambda t: (t.size, t.name))
        self.sizes = [t.size for t in self.templates]
        self.known = frozenset(g for t in self.templates for g in t.bigrams)
        spread = (2 - threshold) / threshold
        self.least = self.sizes[0] / spread if self.sizes else 1
        self.most = self.sizes[-1] * spread if self.sizes else 0
        self.spread = spread
        # Words by number from 1; bigrams by their place among the sorted codes of all.
        self.number = {w: k for k, w in enumerate(sorted({w for g in self.known for w in g}), 1)}
        self.codes = np.array(sorted(self._code(g) for g in self.known), np.int64)
        place = {c: k for k, c in enumerate(self.codes.tolist())}
        own = [{place[self._code(g)]: c for g, c in t.bigrams.items()} for t in self.templates]
        self.own = [(np.array(list(o)), np.array(list(o.values()))) for o in own]
        self.begin = np.cumsum([0] + [len(o) for o in own])[:-1]
        self.all = tuple(np.concatenate(x) for x in zip(*self.own)) if own else None

    def _code(self, gram: tuple[str, str]) -> int:
        return self.number[gram[0]] * (len(self.number) + 1) + self.number[gram[1]]

    @staticmethod
    def _grams(words: list[str]) -> Iterator[tuple[str, str]]:
        return zip(words, words[1:])

    @staticmethod
    def _words(text: str) -> list[str]:
        return _WORD.findall(_lowered(text))

    def best(self, words: list[str]) -> tuple[str, float] | None:
        """The template that a whole passage is most like, if by the threshold."""
        n = len(words) - 1
        if not self.least <= n <= self.most:
            return None
        low, high = bisect_left(self.sizes, n / self.spread - 1e-9), bisect_right(self.sizes, n * self.spread + 1e-9)
        if low == high:
            return None
        shared = sum(map(self.known.__contains__, self._grams(words)))
        if 2 * shared < self.threshold * (n + self.sizes[low]) - 1e-9:
            return None
        grams = Counter(self._grams(words))
        found = None
        for t in self.templates[low:high]:
            both = sum(min(c, t.bigrams[g]) for g, c in grams.items() if g in t.bigrams)
            dice = 2 * both / (n + t.size)
            if dice >= self.threshold and (found is None or (-dice, t.name) < (-found[1], found[0])):
                found = (t.name, dice)
        return found

    def scan(self, text: str) -> list[Found]:
        """Licences of a text's passages, in order and without overlap."""
        low = _lowered(text)
        words = _WORD.findall(low)
        if len(words) - 1 < self.least or self.all is None:
            return []
        ids = np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        code = ids[at] * (len(self.number) + 1) + ids[at + 1]
        gram = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[gram] == code
        at, gram = at[hit], gram[hit]
        chosen: list[Window] = []
        parts = [(0, len(words))]
        while parts:
            low_end, high_end = parts.pop()
            a, b = np.searchsorted(at, (low_end, high_end - 1))
            if b - a < self.least:
                continue
            edge = low_end
            for w in self._apart(self._windows(at[a:b], gram[a:b])):
                chosen.append(w)
                parts.append((edge, w.first))
                edge = w.last + 1
            if edge > low_end:
                parts.append((edge, high_end))
        if not chosen:
            return []
        spots = [m.span() for m in _WORD.finditer(low)]
        return [Found(*self._stretch(text, spots[w.first][0], spots[w.last][1]), w.name, w.dice) for w in sorted(chosen, key=lambda w: w.first)]

    @staticmethod
    def _stretch(text: str, start: int, end: int) -> tuple[int, int]:
        """The place with the punctuation that touches it."""
        while start and not (text[start - 1].isspace() or text[start - 1].isalnum()):
            start -= 1
        while end < len(text) and not (text[end].isspace() or text[end].isalnum()):
            end += 1
        return start, end

    def _windows(self, at: np.ndarray, gram: np.ndarray) -> list[Window]:
        """For each template and start, the passage that is most like it, if by the threshold."""
        counts = np.bincount(gram, minlength=len(self.codes))
        shared = np.add.reduceat(np.minimum(counts[self.all[0]], self.all[1]), self.begin)
        out = []
        for k in np.flatnonzero(shared * self.spread >= np.array(self.sizes) - 1e-9).tolist():
            own = np.zeros(len(self.codes), np.int64)
            own[self.own[k][0]] = self.own[k][1]
            mine = own[gram] > 0
            out += self._of_template(self.templates[k], at[mine], gram[mine], own)
        return out

    def _of_template(self, t: Template, at: np.ndarray, gram: np.ndarray, own: np.ndarray) -> Iterator[Window]:
        n = len(at)
        # A bigram counts from a start on if fewer of its kind than the template has lie between: its place that many back is before the start.
        order = np.argsort(gram, kind="stable")
        source = np.arange(n) - own[gram[order]]
        same = (source >= 0) & (gram[order[source]] == gram[order])
        back = np.full(n, -1)
        back[order[same]] = order[source[same]]
        dense = 2 * np.arange(n) - self.threshold * at
        starts = np.flatnonzero(np.maximum.accumulate(dense[::-1])[::-1] - dense >= self.threshold * (1 + t.size) - 2 - 1e-9)
        width = min(n, int(t.size * self.spread + 1e-9))
        per = max(1, BLOCK // width)
        for begin in range(0, len(starts), per):
            start = starts[begin : begin + per, None]
            end = start + np.arange(width)
            inside = end < n
            end = np.minimum(end, n - 1)
            both = ((back[end] < start) & inside).cumsum(axis=1)
            dice = np.where(inside, 2 * both / (at[end] - at[start] + 1 + t.size), 0)
            top = dice.argmax(axis=1)
            for r in np.flatnonzero(dice.max(axis=1) >= self.threshold).tolist():
                d = float(dice[r, top[r]])
                yield Window(float(both[r, top[r]]) * d, t.name, int(at[start[r, 0]]), int(at[end[r, top[r]]]) + 1, d)

    @staticmethod
    def _apart(windows: list[Window]) -> list[Window]:
        """Windows without overlap, weightiest first, sorted by place."""
        out: list[Window] = []
        if windows:
            low = min(w.first for w in windows)
            taken = np.zeros(max(w.last for w in windows) + 1 - low, bool)
            for w in sorted(windows, key=lambda w: (-w.weight, w.name, w.first)):
                if not taken[w.first - low : w.last + 1 - low].any():
                    taken[w.first - low : w.last + 1 - low] = True
                    out.append(w)
        return sorted(out, key=lambda w: w.first)


def scan(df: DataFrame, threshold: float = 0.8, templates: Sequence[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found array of (start, end, license, dice)) of every row; offsets count code points."""
    chosen = tuple(templates if templates is not None else TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, threshold)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("dice", pa.float64())]))
        for part, texts in slices(batches, "t"):
            found = [[{"start": f.start, "end": f.end, "license": f.name, "dice": f.dice} for f in scanner.scan(t)] if t else [] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(found, kind)], ["k", "found"])

    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, found array<struct<start:int,end:int,license:string,dice:double>>").withColumnRenamed("k", id_col)


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_passages, licenses, best, dice): names sorted and comma-joined; the best passage's name and score."""
    top = F.array_max(F.transform("found", lambda f: F.struct(f["dice"].alias("dice"), (-f["start"]).alias("first"), f["license"].alias("license"))))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda f: f["license"]))), ",")
    return found.select(F.col(id_col), F.size("found").cast("long").alias("n_passages"), names.alias("licenses"), top["license"].alias("best"), top["dice"].alias("dice"))


# Templates, as public licence texts and the notices that point to them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details.
You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
TEMPLATES = (
    ("Apache-2.0", license_texts.APACHE),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_THIRD}\n{_BSD_TAIL}"),
    ("BSL-1.0", license_texts.BOOST),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("AGPL-3.0", _GPL.format("Affero ", "3")),
    ("GPL-2.0", _GPL.format("", "2")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", license_texts.GPL_PREAMBLE),
    ("GPL-3.0", _GPL.format("", "3")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", license_texts.LGPL_EXTRA),
    ("LGPL-3.0", _GPL.format("Lesser ", "3")),
    ("ISC", _ISC),
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", license_texts.MPL_GRANTS),
    ("Unlicense", _UNLICENSE),
    ("Zlib", license_texts.ZLIB),
)
