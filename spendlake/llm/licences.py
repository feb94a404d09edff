"""License scans by Dice coefficient over word bigrams (operator 5).

Texts are normalised (lower case, letters and digits only, copyright clauses left out) and compared
with licence templates: Dice = 2 |A & B| / (|A| + |B|) over distinct word bigrams, where A is any run
of words of the text, across lines and paragraphs.  A run reaches the threshold t with a template of
m bigrams only if it shares m t / (2 - t) of them and has at most m (2 - t) / t; the best run starts
and ends with a bigram of the template.  An index from bigram to templates names the templates that
a text can reach; for those, the best run from each of their bigrams is found.  Of runs over the same
passage the best one counts, and of overlapping runs of one licence.

A copyright clause starts its line, and ends with it or where two bigrams of templates follow each
other (a notice on the same line stays, as does a wrapped line of a notice).

Rows are judged on their own: nothing is shuffled, and memory is one text and the templates.

Defined cases: null and empty texts have no licence; on equal scores the licence first by id
is named; repeated rows are reported once each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# Wording of common licences and of the notices that name them (public texts).
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:")
_MIT_KEEP = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.")
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE.")
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution.")
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.")
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
    "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
    "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
    "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
    "language governing permissions and limitations under the License.")
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
    "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
    "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
    "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE.")
_GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version {} of the License, or (at your option) any "
    "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
    "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
    "for more details. You should have received a copy of the GNU General Public License along with this program. If "
    "not, see <https://www.gnu.org/licenses/>.")
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
    "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means.")
TEMPLATES = (
    ("Apache-2.0", _APACHE_NOTICE),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("GPL-2.0", _GPL_NOTICE.format(2)),
    ("GPL-3.0", _GPL_NOTICE.format(3)),
    ("ISC", _ISC),
    ("MIT", f"{_MIT_GRANT} {_MIT_KEEP} {_MIT_WARRANTY}"),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_WARRANTY),
    ("Unlicense", _UNLICENSE),
)
NOTICES = ("Licensed under {}.", "Released under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.",
           "Distributed under the {}.", "This software is licensed under the {}.", "SPDX-License-Identifier: {}")
NAMES = (
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("ISC", "ISC License"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
)

TOKEN = re.compile(r"[^\W_]+")
COPYRIGHT = re.compile(r"^\W*(copyright|\(c\)|©|all rights reserved)", re.IGNORECASE)
COPYRIGHT_MARKS = ("copyright", "(c)", "©", "all rights reserved")


@dataclass(frozen=True)
class LicenceSettings:
    threshold: float = 0.9


def all_templates() -> list[tuple[str, str]]:
    """(licence id, text): the wordings above and each notice with each name and id."""
    short = [(key, notice.format(name)) for key, name in NAMES for notice in NOTICES]
    ids = [(key, f"SPDX-License-Identifier: {key}") for key in sorted({k for k, _ in NAMES})]
    return [*TEMPLATES, *short, *ids]


def bigrams(text: str) -> frozenset:
    words = TOKEN.findall(text.lower())
    return frozenset(zip(words, words[1:]))


class FirstPlaces:
    """Places where the things of a sequence stand first from a start on, in order, for starts that fall.

    ``before``: where the same thing stood before, or -1.  The places are a linked list: a start moves its
    thing from its next place to the front, so all starts take one step each."""

    def __init__(self, before: np.ndarray):
        n = len(before)
        self.next_same = [-1] * n
        for p, b in enumerate(before.tolist()):
            if b >= 0:
                self.next_same[b] = p
        self.after, self.ahead = [-1] * (n + 1), [-1] * (n + 1)  # linked list; entry n is its head
        self.start = n

    def of(self, start: int, most: int) -> np.ndarray:
        """At most ``most`` places from ``start`` on, which must not rise from call to call."""
        after, ahead, head = self.after, self.ahead, len(self.after) - 1
        while self.start > start:
            self.start -= 1
            p, old = self.start, self.next_same[self.start]
            if old >= 0:
                after[ahead[old]] = after[old]
                if after[old] >= 0:
                    ahead[after[old]] = ahead[old]
            after[p], ahead[p] = after[head], head
            if after[p] >= 0:
                ahead[after[p]] = p
            after[head] = p
        out, p = [], after[head]
        while p >= 0 and len(out) < most:
            out.append(p)
            p = after[p]
        return np.array(out, np.int64)


class Templates:
    """Templates by size, and an index from bigram to templates."""

    def __init__(self, settings: LicenceSettings):
        self.t = settings.threshold
        known: dict[frozenset, str] = {}
        for key, text in all_templates():
            grams = bigrams(text)
            known[grams] = min(key, known.get(grams, key))
        ordered = sorted(known.items(), key=lambda x: (len(x[0]), x[1]))
        self.sizes = [len(g) for g, _ in ordered]
        self.ids = [key for _, key in ordered]
        self.index: dict[tuple, list[int]] = {}
        for k, (grams, _) in enumerate(ordered):
            for g in grams:
                self.index.setdefault(g, []).append(k)
        # shared bigrams that a run needs, and bigrams that it has at most
        self.need = [math.ceil(n * self.t / (2 - self.t) - 1e-9) for n in self.sizes]
        self.most = [math.floor(n * (2 - self.t) / self.t + 1e-9) for n in self.sizes]

    def best(self, grams: frozenset) -> tuple[float, str] | None:
        """Best (score, id) at or above the threshold."""
        n = len(grams)
        lo = bisect_left(self.sizes, n * self.t / (2 - self.t) - 1e-9)
        hi = bisect_right(self.sizes, n * (2 - self.t) / self.t + 1e-9)
        if not n or lo >= hi:
            return None
        shared: dict[int, int] = {}
        for g in grams:
            for k in self.index.get(g, ()):
                if lo <= k < hi:
                    shared[k] = shared.get(k, 0) + 1
        scores = [(-2 * c / (n + self.sizes[k]), self.ids[k]) for k, c in shared.items()]
        score, key = min(scores, default=(0.0, ""))
        return (-score, key) if -score >= self.t else None

    def words(self, text: str) -> list[str]:
        """The text's words without copyright clauses."""
        return [w for w, _ in self._numbered(text)] if self._marked(text) else TOKEN.findall(text.lower())

    @staticmethod
    def _marked(text: str) -> bool:
        low = text.lower()
        return any(x in low for x in COPYRIGHT_MARKS)

    def _numbered(self, text: str) -> list[tuple[str, int]]:
        """(word, line) of the text's words without copyright clauses."""
        words: list[tuple[str, int]] = []
        clauses = []
        for i, line in enumerate(text.split("\n")):
            start = len(words)
            words += [(w, i) for w in TOKEN.findall(line.lower())]
            if COPYRIGHT.match(line):
                clauses.append((start, len(words)))
        gone: set[int] = set()
        for start, end in clauses:
            for p in range(start, end):
                if all((x[0], y[0]) in self.index for x, y in zip(words[p : p + 2], words[p + 1 : p + 3])) and p + 2 < len(words):
                    break
                gone.add(p)
        return [x for p, x in enumerate(words) if p not in gone]

    def runs(self, words: list[str]) -> list[tuple[float, str, int, int]]:
        """(score, id, first word, word after the last) of the best run from each bigram of each template
        that the text can reach, where it is at or above the threshold."""
        at: dict[tuple, list[int]] = {}
        index = self.index
        for p, g in enumerate(zip(words, words[1:])):
            if g in index:
                at.setdefault(g, []).append(p)
        shared: dict[int, int] = {}
        for g in at:
            for k in index[g]:
                shared[k] = shared.get(k, 0) + 1
        reach = [k for k, c in shared.items() if c >= self.need[k]]
        if not reach:
            return []
        n = len(words) - 1
        before = np.full(n, -1, np.int64)  # where the same bigram stands before
        last: dict[tuple, int] = {}
        for p, g in enumerate(zip(words, words[1:])):
            before[p] = last.get(g, -1)
            last[g] = p
        out: list[tuple[float, str, int, int]] = []
        insides, late = {}, []

        def best(k: int, s: int, new: np.ndarray) -> None:
            """Adds the best run from s, where ``new`` are the places of the first bigrams new to it."""
            common = np.cumsum(insides[k][new])
            if common[-1] < self.need[k]:
                return
            scores = 2 * common / (np.arange(1, len(new) + 1) + self.sizes[k])
            e = int(scores.argmax())
            if scores[e] >= self.t:
                out.append((float(scores[e]), self.ids[k], s, int(new[e]) + 2))

        for k in reach:
            inside = insides[k] = np.zeros(n, bool)
            for g, places in at.items():
                if k in index[g]:
                    inside[places] = True
            span = 2 * self.most[k]
            for s in np.flatnonzero(inside).tolist():
                new = s + np.flatnonzero(before[s : s + span] < s)[: self.most[k]]
                if len(new) == self.most[k] or s + span >= n or np.count_nonzero(inside[new]) == shared[k]:
                    best(k, s, new)
                else:
                    late.append((s, k))
        if late:  # repetitive from here: more than half of the span stood before
            late.sort(reverse=True)
            firsts = FirstPlaces(before)
            for s, k in late:
                best(k, s, firsts.of(s, self.most[k]))
        return out

    def scan(self, text: str) -> list[tuple[float, str, int]]:
        """(score, id, line) of the matches."""
        found = self.runs(self.words(text))
        if not found:
            return []
        lines = [i for _, i in self._numbered(text)]
        longest = max(e - s for _, _, s, e in found)
        taken: dict[str, bytearray] = {}
        chosen: list[tuple[int, int, str, float]] = []  # by first word
        for score, key, s, e in sorted(found, key=lambda x: (-x[0], x[1], x[2] - x[3], x[2])):
            own = taken.setdefault(key, bytearray(len(lines)))
            if own.find(1, s, e) >= 0:
                continue
            near = chosen[bisect_left(chosen, (s - longest,)) : bisect_left(chosen, (e,))]
            if any(2 * (min(e, y) - max(s, x)) > max(e - s, y - x) for x, y, _, _ in near):
                continue  # the same passage as a better one
            own[s:e] = b"\1" * (e - s)
            insort(chosen, (s, e, key, score))
        return [(score, key, lines[s]) for s, _, key, score in chosen]


def licence_report(docs: DataFrame, settings: LicenceSettings = LicenceSettings()) -> DataFrame:
    """Per document: doc_id, license (best match, or null), score, n_matches, licenses (all ids, sorted)."""

    def make():
        templates = Templates(settings)

        def scan(texts):
            best, score, n, ids = [], [], [], []
            for t in texts.to_pylist():
                found = templates.scan(t) if t else []
                top = min(found, key=lambda x: (-x[0], x[1]), default=None)
                best.append(top[1] if top else None)
                score.append(top[0] if top else 0.0)
                n.append(len({(x[1], x[2]) for x in found}))
                ids.append(sorted({x[1] for x in found}))
            return best, score, n, ids

        return scan

    fields = [("license", "string"), ("score", "double"), ("n_matches", "bigint"), ("licenses", "array<string>")]
    return map_arrow(docs.select(F.col("doc_id"), F.col("text")), ["doc_id"], ["text"], fields, make)
