"""Licence scans with a generalised suffix automaton of licence texts.

The words of all templates go into one automaton.  A text's words stream through it; at every word
it knows the longest run of words ending there that stands in some template (matching statistics), and
by its suffix links the longest that stands in each other one.  Runs of MIN_MATCH words or more are
placed on each template on which they can't be prolonged, and chained: matches in the same order in
text and template, with gaps of at most ``allowed_gap`` words, which is none in a template of one
sentence: a word put in or left out there makes another licence of it (``NoDerivatives``, ``Lesser``).
A chain's coverage is its template words matched, over the template's or the span's words, whichever are more.  A
coverage of MIN_COVER or more gives the template's label and a span, unless the span overlaps one of
another label with a better coverage: of kindred licences the one that fits best stands.

Beside the templates, fixed base phrases are located wherever their words stand in a row.

Only words that occur in a template can prolong a match, so the automaton is run on the stretches of
at least MIN_MATCH such words; every word of every text is looked up for that, by its bytes.

Defined results
---------------
* A null text counts as empty: no words, no labels, score 0, null first and last word.
* Repeated rows get equal results.  An empty table gives no rows.  Other columns are not looked at.
* Every chain of MIN_COVER or more gives a span, unless it overlaps a better one of its template; of equal
  ones the earliest.  Spans of different labels with equal coverage both stand.  score: the largest
  coverage, 1 with a base phrase.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heapify, heappop, heappush
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craterloom.llm.chunks import ragged
from craterloom.llm.core import slices, text_bytes, tidy

MIN_MATCH, MAX_GAP, MIN_COVER = 3, 12, 0.75


def allowed_gap(size: int) -> int:
    """Words that may stand between two matches of a chain, in the text or in a template of this size."""
    return min(MAX_GAP, size // 20)


#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: The Creative Commons licences' labels, names and short names, and their versions.
CREATIVE = (
    ("cc-by", "Attribution", "CC BY"), ("cc-by-sa", "Attribution-ShareAlike", "CC BY-SA"), ("cc-by-nd", "Attribution-NoDerivatives", "CC BY-ND"),
    ("cc-by-nc", "Attribution-NonCommercial", "CC BY-NC"), ("cc-by-nc-sa", "Attribution-NonCommercial-ShareAlike", "CC BY-NC-SA"),
    ("cc-by-nc-nd", "Attribution-NonCommercial-NoDerivatives", "CC BY-NC-ND"),
)
CREATIVE_VERSIONS = (("4.0", "International"), ("3.0", "Unported"), ("2.0", "Generic"))

#: Public licence notices and texts, with their labels.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
        IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsl-1.0", """Boost Software License - Version 1.0 - August 17th, 2003
        Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"""),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
        OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution."""),
)

TEMPLATES = NOTICES + tuple(
    (label, text) for label, name, short in CREATIVE for version, scope in CREATIVE_VERSIONS
    for text in (f"This work is licensed under a Creative Commons {name} {version} {scope} License", f"Licensed under {short} {version}")
)

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = True
_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of lower-cased data, and the word offsets of its rows."""
    inside = _WORD[data]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = first[1:] - 1
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


class SuffixAutomaton:
    """Generalised over word sequences; occurrences(state) lists (sequence, end) of a state's words."""

    def __init__(self, sequences: list[list[int]]):
        self.sequences = sequences
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w, ends)
                ends[last].append((number, i + 1))
        self.ends = ends
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.longest[s]):
            ends[self.link[state]] += ends[state]

    def _new(self, longest: int, nxt: dict[int, int], link: int, ends: list) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.longest.append(longest)
        ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, w: int, ends: list) -> int:
        """The state of p's words and w exactly, cut out of the state that w leads to if need be."""
        q = self.next[p][w]
        if self.longest[q] == self.longest[p] + 1:
            return q
        clone = self._new(self.longest[p] + 1, dict(self.next[q]), self.link[q], ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int, ends: list) -> int:
        if w in self.next[last]:
            return self._split(last, w, ends)
        state = self._new(self.longest[last] + 1, {}, 0, ends)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, w, ends)
        return state

    def statistics(self, words: list[int]):
        """(state, length) of the longest template run that ends at each word."""
        state = length = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.longest[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            yield state, length

    def matches(self, words: list[int], least: int):
        """(end, length, sequence, sequence end) of the runs of at least this many words that can't be prolonged on that sequence.

        At each word the state's own occurrences have the whole run; those that only its suffix links have, the words of that link.
        """
        for i, (state, length) in enumerate(self.statistics(words)):
            if length < least:
                continue
            following = words[i + 1] if i + 1 < len(words) else None
            held = set()
            while length >= least:
                for number, at in self.ends[state]:
                    if (number, at) not in held:
                        held.add((number, at))
                        own = self.sequences[number]
                        if at == len(own) or own[at] != following:
                            yield i + 1, length, number, at
                state = self.link[state]
                length = self.longest[state]


class Scanner:
    """Numbers of the words that templates and base phrases have, and the automaton."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        texts = [self._words(t.encode()) for _, t in templates] + [self._words(p.encode()) for p, _ in base]
        known = sorted({w for words in texts for w in words})
        number = {w: i for i, w in enumerate(known)}
        self.known = pa.array(known, pa.large_binary())
        coded = [[number[w] for w in words] for words in texts]
        self.labels, self.sizes = [x for x, _ in templates], [len(c) for c in coded[:len(templates)]]
        self.automaton = SuffixAutomaton(coded[:len(templates)])
        self.base = [(label, coded[len(templates) + i]) for i, (_, label) in enumerate(base)]
        self.sieve = np.zeros(1 << 21, bool)  # by first and last byte and length
        self.sieve[[w[0] | w[-1] << 8 | min(len(w), 31) << 16 for w in known]] = True

    @staticmethod
    def _words(raw: bytes) -> list[bytes]:
        data = _LOWER[np.frombuffer(raw, np.uint8)]
        starts, ends, _ = word_ranges(data, np.array([0, len(data)]))
        return [data[a:b].tobytes() for a, b in zip(starts, ends)]

    def numbers(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word, -1 for one that no template or phrase has, and the word offsets of the rows."""
        data = _LOWER[data]
        starts, ends, rows = word_ranges(data, offsets)
        out, size = np.full(len(starts), -1, np.int32), ends - starts
        maybe = np.flatnonzero(self.sieve[data[starts].astype(np.int64) | data[ends - 1].astype(np.int64) << 8 | np.minimum(size, 31) << 16])
        if len(maybe):
            size = size[maybe]
            words = pa.Array.from_buffers(pa.large_binary(), len(maybe), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(data[ragged(starts[maybe], size)])])
            out[maybe] = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False)
        return out, rows

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """(n_words, base places [(word, label)], spans [(label, first word, last word, coverage)]) of each row."""
        number, rows = self.numbers(data, offsets)
        out = [(int(b - a), [], []) for a, b in zip(rows[:-1], rows[1:])]
        row_of = lambda at: int(np.searchsorted(rows, at, "right")) - 1
        for label, phrase in self.base:
            n = len(phrase)
            if len(number) < n:
                continue
            hit = number[:len(number) - n + 1] == phrase[0]
            for k in range(1, n):
                hit &= number[k:len(number) - n + 1 + k] == phrase[k]
            for at in np.flatnonzero(hit).tolist():
                r = row_of(at)
                if at + n <= rows[r + 1]:
                    out[r][1].append((at - int(rows[r]), label))
        # stretches of known words, cut at row borders
        known = (number >= 0).astype(np.int8)
        edge = np.diff(known, prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = last - first >= MIN_MATCH
        placed: dict[tuple[int, int], list] = {}
        for a, b in zip(first[long].tolist(), last[long].tolist()):
            r = row_of(a)
            while a < b:
                e = min(b, int(rows[r + 1]))
                if e - a >= MIN_MATCH:
                    for end, length, t, t_end in self.automaton.matches(number[a:e].tolist(), MIN_MATCH):
                        stop = a - int(rows[r]) + end
                        placed.setdefault((r, t), []).append((stop - length, stop, t_end - length, t_end))
                a, r = e, r + 1
        spans: dict[int, list] = {}
        for (r, t), found in placed.items():
            for cover, start, stop in self.chains(found, MIN_COVER * self.sizes[t], self.sizes[t]):
                if (cover := cover / max(self.sizes[t], stop - start)) >= MIN_COVER:
                    spans.setdefault(r, []).append((self.labels[t], start, stop - 1, cover))
        for r, found in spans.items():
            out[r][2].extend(self.fittest(found))
        return out

    @staticmethod
    def fittest(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
        """The spans that no kept span of another label with a better coverage overlaps; the best are looked at first."""
        kept: list[tuple[str, int, int, float]] = []
        by_place: dict[int, list] = {}  # kept spans, by each 64 words that they touch
        for span in sorted(spans, key=lambda x: (-x[3], x[1], x[2], x[0])):
            label, first, last, cover = span
            cells = range(first >> 6, (last >> 6) + 1)
            rivals = (x for c in cells for x in by_place.get(c, ()))
            if not any(x[0] != label and x[3] > cover and x[1] <= last and first <= x[2] for x in rivals):
                kept.append(span)
                for c in cells:
                    by_place.setdefault(c, []).append(span)
        return kept

    @staticmethod
    def chains(found: list[tuple[int, int, int, int]], least: float, size: int) -> list[tuple[int, int, int]]:
        """Chains of matches (text start, end, template start, end) that cover ``least`` words of a template of this size.

        Best first, each with its template words covered, text start and end; the earliest of equal ones; none
        overlaps a better one.  The matches that a chain leaves behind it are chained anew, as far as it can matter.
        """
        found.sort()
        gap = allowed_gap(size)
        best: list[tuple[int, int, int]] = []
        gone = [False] * len(found)
        reach = list(accumulate((m[1] for m in found), max))  # no match up to here ends later
        starts = [m[0] for m in found]

        def chain(i: int, first: int) -> tuple[int, int, int]:
            """Best chain that ends with match i and begins at this match or later."""
            a, b, ta, tb = found[i]
            own = (tb - ta, a, b)
            for j in range(max(first, bisect_left(reach, a - gap)), i):
                pb, pta, ptb = found[j][1:]
                over = max(0, pb - a, ptb - ta)  # words that both would count
                if not gone[j] and pta < ta and ptb < tb and pb < b and over < tb - ta and a - pb <= gap and ta - ptb <= gap:
                    cover = best[j][0] + tb - ta - over
                    if cover > own[0]:
                        own = (cover, best[j][1], b)
            return own

        for i in range(len(found)):
            best.append(chain(i, 0))
        queue = [(-c, a, b, i) for i, (c, a, b) in enumerate(best) if c >= least]
        heapify(queue)
        out = []
        while queue:
            c, start, stop, i = heappop(queue)
            if gone[i] or best[i] != (-c, start, stop):
                continue
            out.append(best[i])
            # a chain's text is at most so long, so that matches farther off have nothing to do with this one
            span = size * (gap + 1)
            first = bisect_left(starts, stop)
            for j in range(bisect_left(starts, start - span), first):
                gone[j] = gone[j] or found[j][1] > start
            for j in range(first, bisect_left(starts, stop + span)):
                if not gone[j] and best[j][1] < stop:
                    best[j] = chain(j, first)
                    if best[j][0] >= least:
                        heappush(queue, (-best[j][0], *best[j][1:], j))
        return out


_SCANNER: list[Scanner] = []

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,coverage:double>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, with the spans of all labels that the automaton found."""
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64(),
             pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))]

    def run(batches):
        if not _SCANNER:
            _SCANNER.append(Scanner())
        for b in batches:
            doc_ids = b["id"].to_pylist()
            data, offsets = text_bytes(b["text"])
            for i, j in slices(offsets):
                rows = []
                for doc, (n, base, spans) in zip(doc_ids[i:j], _SCANNER[0].scan(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])):
                    places = [p for p, _ in base]
                    base_labels = {x for _, x in base}
                    score = 1.0 if base else max((round(s[3], 9) for s in spans), default=0.0)
                    spans = sorted((s[1], s[2], s[0], round(s[3], 9)) for s in spans)
                    rows.append((doc, n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)),
                                 ",".join(sorted(base_labels | {s[2] for s in spans})), score, [{"label": x, "first_word": p, "last_word": q, "coverage": c} for p, q, x, c in spans]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run), SCHEMA)


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).drop("spans")
