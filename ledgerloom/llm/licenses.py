"""License scans with a generalised suffix automaton of licence texts.

The automaton holds every run of words of every template. A document's words stream through it and give matching
statistics: at each word, the longest run ending there that some template has. Runs of at least `least` words that can't
grow are matches; matches that go forward in one template and leave at most `gap` words out in the document and in the
template are chained (a run that the template has several times may stand for each of them). A chain labels the document
if it covers `cover` words, or half of its template, and `least` of its words stand in runs that templates of no other
label have, so that wording which many notices share, or everyday prose, labels nothing. Words that no
template has are found in numpy beforehand, and only runs of known words long enough to matter are streamed. Fixed
phrases (the base) label a document wherever they stand.

A null text is empty: no words, no places, null first and last word, score 0. Repeated rows are scanned alike; empty
tables give no rows; columns of docs named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Carried, HashSet, Words, slices

#: Phrases and labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The wording of well-known notices, by label.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_RESULT = pa.schema([("n_words", pa.int64()), ("places", pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("template_start", pa.int64()), ("template_stop", pa.int64()), ("matched", pa.int64())]))), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64())])
_DDL = "n_words long, places array<struct<start:long,label:string>>, spans array<struct<label:string,start:long,stop:long,template_start:long,template_stop:long,matched:long>>, base_labels array<string>, labels array<string>, score double"


class Automaton:
    """Suffix automaton over several word sequences; each state knows where its runs end in each sequence."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]  # sequence: ends (exclusive), in order
        for n, words in enumerate(sequences):
            at = 0
            for end, w in enumerate(words, 1):
                at = self._add(at, w)
                s = at
                while s > 0:
                    self.ends[s].setdefault(n, []).append(end)
                    s = self.link[s]

    def _state(self, length: int, link: int, onward: dict[int, int], ends: dict[int, list[int]]) -> int:
        self.next.append(onward)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(ends)
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of p's longest run and w, cut from the state it shares with longer runs where that is needed."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), {n: list(e) for n, e in self.ends[q].items()})
        self.link[q] = own
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = own
            p = self.link[p]
        return own

    def _add(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._state(self.length[last] + 1, 0, {}, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def matches(self, words: list[int], least: int) -> list[tuple[int, int, int]]:
        """(start, stop, state) of the runs of `words` that some sequence has and that can't grow to either side."""
        out, s, n = [], 0, 0
        for i, w in enumerate(words):
            if w not in self.next[s]:
                if n >= least:
                    out.append((i - n, i, s))
                while s > 0 and w not in self.next[s]:
                    s = self.link[s]
                    n = self.length[s]
            if w in self.next[s]:
                s, n = self.next[s][w], n + 1
            else:
                s, n = 0, 0
        if n >= least:
            out.append((len(words) - n, len(words), s))
        return out


class _Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str], least: int, gap: int, cover: int):
        self.labels, self.least, self.gap, self.cover = list(templates), least, gap, cover
        hashed = [Words([t]).hashes(1) for t in templates.values()]
        self.known = HashSet(np.concatenate(hashed))
        self.sequences = [np.searchsorted(self.known.values, h).tolist() for h in hashed]
        self.automaton = Automaton(self.sequences)
        self.phrases: dict[int, dict[int, tuple[bytes, str]]] = {}
        for p, label in phrases.items():
            k = p.count(" ") + 1
            self.phrases.setdefault(k, {})[int(Words([p]).hashes(k)[0])] = (p.encode(), label)
        self.sets = {k: HashSet(np.array(list(v), np.uint64)) for k, v in self.phrases.items()}

    def chains(self, found: list[tuple[int, int, int]]) -> list[dict]:
        """Matches of one document (in order) joined to spans by template."""
        live: dict[int, list[list[int]]] = {}
        done: dict[int, list[list[int]]] = {}
        for lo, hi, s in found:
            own = len({self.labels[n] for n in self.automaton.ends[s]}) == 1
            for n, ends in self.automaton.ends[s].items():
                near = []
                for c in live.get(n, []):  # start, stop, template start and stop, words matched, words of this label only
                    (near if lo - c[1] <= self.gap else done.setdefault(n, [])).append(c)
                grown = False
                for c in near:
                    skip = max(0, c[1] - lo)  # words that the chain has already
                    t = min((end - (hi - lo) + skip for end in ends if 0 <= end - (hi - lo) + skip - c[3] <= self.gap), default=None)
                    if t is not None and skip < hi - lo:
                        c[1], c[3], c[4], c[5] = hi, t + hi - lo - skip, c[4] + hi - lo - skip, c[5] + own * (hi - lo - skip)
                        grown = True
                if not grown:
                    near += [[lo, hi, end - (hi - lo), end, hi - lo, own * (hi - lo)] for end in ends]
                live[n] = near
        spans = []
        for n in sorted({*live, *done}):
            size = len(self.sequences[n])
            enough = [c for c in done.get(n, []) + live.get(n, []) if (c[4] >= self.cover or 2 * c[4] >= size) and c[5] >= min(self.least, size)]
            best: list[list[int]] = []
            for c in sorted(enough):
                if not best or c[0] >= best[-1][1]:
                    best.append(c)
                elif c[4] > best[-1][4]:
                    best[-1] = c
            spans += [{"label": self.labels[n], "start": c[0], "stop": c[1], "template_start": c[2], "template_stop": c[3], "matched": c[4]} for c in best]
        return spans

    def scan(self, texts: list[str | None]) -> pa.RecordBatch:
        w = Words(texts)
        doc = w.text_of()
        places: dict[int, list[dict]] = {}
        for k, own in self.sets.items():
            at, i = own.find(w.hashes(k))
            for p, j in zip(at.tolist(), i.tolist()):
                phrase, label = self.phrases[k][int(own.values[j])]
                if doc[p] == doc[p + k - 1] and w.run(p, k) == phrase:
                    places.setdefault(int(doc[p]), []).append({"start": p - int(w.first[doc[p]]), "label": label, "_k": k})
        at, i = self.known.find(w.hashes(1))
        found: dict[int, list[tuple[int, int, int]]] = {}
        if len(at):
            cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(doc[at]) != 0)) + 1
            for lo, hi in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(at)]]).tolist()):
                if hi - lo >= self.least:
                    d = int(doc[at[lo]])
                    base = int(at[lo] - w.first[d])
                    found.setdefault(d, []).extend((base + a, base + b, s) for a, b, s in self.automaton.matches(i[lo:hi].tolist(), self.least))
        rows = []
        for d in range(len(texts)):
            n = int(w.first[d + 1] - w.first[d])
            own = sorted(places.get(d, []), key=lambda x: x["start"])
            spans = self.chains(found[d]) if d in found else []
            base = sorted({x["label"] for x in own})
            covered = reach = 0
            for lo, hi in sorted([(x["start"], x["start"] + x["_k"]) for x in own] + [(x["start"], x["stop"]) for x in spans]):
                covered += max(0, hi - max(lo, reach))
                reach = max(reach, hi)
            rows.append({"n_words": n, "places": [{"start": x["start"], "label": x["label"]} for x in own], "spans": spans, "base_labels": base, "labels": sorted({*base, *(x["label"] for x in spans)}), "score": covered / n if n else 0.0})
        return pa.RecordBatch.from_pylist(rows, schema=_RESULT)


_scanners: dict[str, _Scanner] = {}


def scan_licenses(docs: DataFrame, *, text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, least: int = 5, gap: int = 8, cover: int = 16) -> DataFrame:
    """docs with n_words, places (of phrases), spans (of templates; words, end exclusive), base_labels, labels and score.

    score is the share of the words that lie in a place or a span.
    """
    own = Carried(docs, _RESULT.names)
    names = own.names
    rows = docs.select(F.col(text_col).cast("string").alias("text"), *own.into)
    options = (phrases, templates, least, gap, cover)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if repr(options) not in _scanners:
            _scanners[repr(options)] = _Scanner(*options)
        scanner = _scanners[repr(options)]
        for b in slices(batches, 0):
            found = scanner.scan(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *found.columns], names=[*names, *_RESULT.names])

    return rows.mapInArrow(scan, StructType([*own.schema.fields, *StructType.fromDDL(_DDL).fields])).select(*own.back, *_RESULT.names)
