"""Licence scans: matching statistics against a generalised suffix automaton of licence templates, chained to spans.

Templates are the notices that the licences ask for, as words. A text's words stream through the automaton, which
gives at each word the longest run ending there that some template holds. Runs that cannot be extended and have
MIN_MATCH words or more are matches; for each template, matches that follow each other in text and template, with
at most MAX_GAP words between them in the text, are chained, and a chain that covers MIN_COVER of the template, or
LONG_RUN words in a row, is a span and gives the template's label. Short fixed phrases are found beside that.

Only words of the templates or phrases can take part, so the automaton runs over stretches of at least MIN_MATCH
such words; texts are whole, cut nowhere. A null or empty text has no words. Rows are scanned one by one: ties and
repeated rows play no part, an empty table gives an empty one, other columns pass through,
those named like a new column are replaced.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .core import NON_ALNUM, column_bytes, slices, tidy, words

# Phrases and their labels, and public licence notices.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: In words.
MIN_MATCH, MAX_GAP, LONG_RUN = 4, 12, 16
#: Share of a template.
MIN_COVER = 0.6
#: Score of a text with a phrase but no better span.
PHRASE_SCORE = 0.5


def tokens(texts: list[str]) -> list[np.ndarray]:
    buf, offsets = column_bytes(pa.array(texts, pa.string()))
    h, _, _, first = words(buf, offsets, NON_ALNUM, True)
    return [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


class Automaton:
    """A suffix automaton of several token strings. ends: for each state, where its strings end, by template."""

    def __init__(self, strings: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for t, string in enumerate(strings):
            last = 0
            for i, token in enumerate(string):
                last = self._extend(last, token)
                self.ends[last].add((t, i + 1))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, link: int, next_: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(next_)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, state: int, target: int, token: int) -> int:
        """The state of the longest string of target that extends state by token, cloned off if target is longer."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:  # an earlier template has this string
            return self._split(last, self.next[last][token], token)
        new, state = self._state(self.length[last] + 1, 0, {}), last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, self.next[state][token], token)
        return new

    def matches(self, string: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of every run that cannot be extended; the statistics of the whole string in one pass."""
        state = length = 0
        for i, token in enumerate(string):
            if token not in self.next[state]:
                if length:
                    yield i, length, state
                while state and token not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            else:
                length = 0
        if length:
            yield len(string), length, state


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES):
        strings = tokens([t for _, t in templates])
        phrase_words = tokens([p for p, _ in phrases])
        self.known = np.unique(np.concatenate([*strings, *phrase_words]))
        ids = lambda h: np.searchsorted(self.known, h).tolist()
        self.sizes = [len(s) for s in strings]
        self.labels, self.automaton = [label for label, _ in templates], Automaton([ids(s) for s in strings])
        self.phrases = [(ids(p), label) for p, (_, label) in zip(phrase_words, phrases, strict=True)]
        self.shortest = min(MIN_MATCH, *(len(p) for p, _ in self.phrases))

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, share of the template) of the chains that count. matches: (start, end, state)."""
        by_template: dict[int, list[tuple[int, int, int, int]]] = {}
        for start, end, state in matches:
            for t, at in self.automaton.ends[state]:
                by_template.setdefault(t, []).append((start, end, at - (end - start), at))
        out = []
        for t, own in by_template.items():
            own.sort()
            best: list[tuple[int, int, int, int]] = []  # words covered, first word, longest run, previous
            for k, (s, e, a, b) in enumerate(own):
                found = (e - s, s, e - s, -1)
                for j in range(k - 1, -1, -1):
                    s2, e2, a2, b2 = own[j]
                    if s - s2 > MAX_GAP + self.sizes[t]:
                        break
                    shift = max(0, e2 - s, b2 - a)  # words that both would cover
                    if s2 < s and a2 < a and s - e2 <= MAX_GAP and shift < e - s and best[j][0] + e - s - shift > found[0]:
                        found = (best[j][0] + e - s - shift, best[j][1], max(best[j][2], e - s), j)
                best.append(found)
            starts: list[int] = []  # of the spans taken, which are disjoint
            ends: list[int] = []
            for covered, s, run, k in sorted(((c, s, r, k) for k, (c, s, r, _) in enumerate(best)), key=lambda x: (-x[0], x[1])):
                e = own[k][1]
                i = bisect.bisect_right(starts, s)
                free = (i == 0 or ends[i - 1] <= s) and (i == len(starts) or e <= starts[i])
                if free and (covered >= MIN_COVER * self.sizes[t] or run >= LONG_RUN):
                    starts.insert(i, s)
                    ends.insert(i, e)
                    out.append((self.labels[t], s, e, min(1.0, covered / self.sizes[t])))
        return sorted(out, key=lambda x: (x[1], x[2], x[0], x[3]))

    def scan(self, h: np.ndarray) -> dict:
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hit = self.known[at] == h
        places, base, matches = [], set(), []
        if hit.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if e - s < self.shortest:
                    continue
                ids = at[s:e].tolist()
                for phrase, label in self.phrases:
                    for i in range(len(ids) - len(phrase) + 1):
                        if ids[i] == phrase[0] and ids[i : i + len(phrase)] == phrase:
                            places.append(s + i)
                            base.add(label)
                if e - s >= MIN_MATCH:
                    matches += [(s + end - n, s + end, state) for end, n, state in self.automaton.matches(ids) if n >= MIN_MATCH]
        spans = self.spans(matches) if matches else []
        return {
            "n_words": len(h),
            "n_base": len(places),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {x[0] for x in spans})),
            "score": max([x[3] for x in spans] + [PHRASE_SCORE if places else 0.0]),
            "spans": [{"label": a, "first": b, "end": c, "covered": d} for a, b, c, d in spans],
        }


_SPAN = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("covered", T.DoubleType())]))
_FIELDS = [(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")] + [("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("spans", _SPAN)]
_ARROW = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))]


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """The input's rows and columns with n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    documents = documents.drop(*({c for c, _ in _FIELDS} - {text}))
    schema = T.StructType([*documents.schema.fields, *(T.StructField(c, t) for c, t in _FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        scanner = Scanner()
        for batch in batches:
            buf, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
            for i, j in slices(offsets):
                h, _, _, first = words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NON_ALNUM, True)
                found = [scanner.scan(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                made = [pa.array([x[c] for x in found], t) for (c, _), t in zip(_FIELDS, _ARROW, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *made], names=schema.names)

    return documents.mapInArrow(run, schema)
