"""License scans by a generalised suffix automaton of licence tokens.

The automaton holds every factor of all template token sequences. A text is
streamed through it once: after each word the state and match length are the
longest suffix read so far that is a factor of some template (the matching
statistic). Matches of at least ``least`` words that end where they can't be
extended become spans of the templates that contain them; spans of one template
that follow each other in text and template order, with small gaps, are chained,
and a chain that covers enough of its template is a finding. Phrases of the base
labels are templates too: a phrase stands at a place when its state is on the
suffix path, that is when the matched factor ends with it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels. Fixed values of the contract.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Licence passages that the method labels itself: public licence wording, one or more templates a label. Fixed values.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "released under the mit license",
        "licensed under the mit license",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "licensed under the apache license version 2 0",
        "released under the apache license version 2 0",
    ],
    "gpl-3.0": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "licensed under the gnu general public license version 3",
        "you should have received a copy of the gnu general public license along with this program",
    ],
    "gpl-2.0": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        "licensed under the gnu general public license version 2",
    ],
    "lgpl": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        "licensed under the gnu lesser general public license version",
    ],
    "agpl-3.0": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "licensed under the gnu affero general public license version 3",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "licensed under the bsd license",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "zlib": [
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    ],
    "unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "creative commons zero v1 0 universal", "released under cc0 1 0"],
    "cc-by-4.0": ["this work is licensed under a creative commons attribution 4 0 international license", "licensed under cc by 4 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"],
    "epl-2.0": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at"],
    "no-warranty": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ],
}

#: Byte table: A-Z to a-z, other ASCII but letters and digits to a space, the rest kept.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word ids."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: state -> [(template, end position)] of the prefixes that make it
        self.ends: list[list[tuple[int, int]]] = [[]]

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def add(self, sequence: list[int], template: int) -> None:
        last = 0
        for at, c in enumerate(sequence):
            last = self._extend(last, c)
            self.ends[last].append((template, at))

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def occurrences(self) -> list[list[tuple[int, int]]]:
        """For each state, all (template, end) where its factors end in the templates."""
        full = [list(e) for e in self.ends]
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                full[self.link[s]] += full[s]
        return [sorted(set(e)) for e in full]


class Scanner:
    """Finds base phrases and template spans in texts."""

    def __init__(self, base: dict[str, str], templates: dict[str, list[str]], least: int = 4, gap: int = 6, cover: float = 0.6):
        self.least, self.gap, self.cover = least, gap, cover
        self.words: dict[bytes, int] = {}
        number = lambda text: [self.words.setdefault(w, len(self.words)) for w in words_of(text)]
        self.sam = SuffixAutomaton()
        self.templates: list[tuple[str, int]] = []
        for label, texts in templates.items():
            for t in texts:
                ids = number(t)
                self.sam.add(ids, len(self.templates))
                self.templates.append((label, len(ids)))
        self.phrases = [(number(p), label) for p, label in base.items()]
        for ids, _ in self.phrases:
            self.sam.add(ids, -1)
        self.where = [[o for o in occ if o[0] >= 0] for occ in self.sam.occurrences()]
        #: state -> phrases (index) that end where a match in this state ends, if it is long enough
        self.phrase_at: dict[int, list[int]] = {}
        for i, (ids, _) in enumerate(self.phrases):
            s = 0
            for c in ids:
                s = self.sam.next[s][c]
            for state in range(len(self.sam.next)):
                up = state
                while up > 0 and up != s:
                    up = self.sam.link[up]
                if up == s:
                    self.phrase_at.setdefault(state, []).append(i)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[tuple[str, int, int, float]]]:
        """(number of words, base places as (start, phrase), findings as (label, start, end, covered share))."""
        words = words_of(text)
        ids = list(map(self.words.get, words))
        nxt, link, length = self.sam.next, self.sam.link, self.sam.length
        places: list[tuple[int, int]] = []
        spans: dict[int, list[tuple[int, int, int]]] = {}  # template -> (text start, template start, words)
        state = size = 0
        before = None  # where the last known word stood; runs of unknown words are skipped at once
        known = [i for i, w in enumerate(ids) if w is not None]
        for i in known:
            if before is not None and i != before + 1:
                self._span(spans, state, size, before)
                state = size = 0
            before, c = i, ids[i]
            if c not in nxt[state]:
                self._span(spans, state, size, i - 1)
                while state and c not in nxt[state]:
                    state = link[state]
                    size = length[state]
            if c in nxt[state]:
                state, size = nxt[state][c], size + 1
            else:
                state = size = 0
            for p in self.phrase_at.get(state, ()):
                n = len(self.phrases[p][0])
                if size >= n:
                    places.append((i - n + 1, p))
        if before is not None:
            self._span(spans, state, size, before)
        return len(words), places, self._chains(spans)

    def _span(self, spans, state: int, size: int, end: int) -> None:
        if size >= self.least:
            for t, at in self.where[state]:
                spans.setdefault(t, []).append((end - size + 1, at - size + 1, size))

    def _chains(self, spans) -> list[tuple[str, int, int, float]]:
        found = []
        for t, parts in spans.items():
            label, n = self.templates[t]
            done: list[list[int]] = []  # [text start, text end, template end, covered]
            open_: list[list[int]] = []
            for start, at, size in sorted(parts):
                # the chain that this span best goes on with: text and template move on together
                best, still = None, []
                for chain in open_:
                    skip, jump = start - chain[1], at - chain[2]
                    (done if skip > self.gap else still).append(chain)
                    if 0 <= skip <= self.gap and 0 <= jump <= self.gap and (best is None or chain[3] > best[3]):
                        best = chain
                open_ = still
                if best is not None:
                    best[1], best[2], best[3] = start + size, at + size, best[3] + size
                else:
                    open_.append([start, start + size, at + size, size])
            found += [(label, a, b, covered / n) for a, b, _, covered in done + open_ if covered >= max(self.least, self.cover * n)]
        return sorted(found, key=lambda f: (f[1], f[2], f[0]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """A row for each row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans has each finding with its label, first word, end and the covered
    share of its template; score is the share of the text's words that base
    phrases or findings cover. Null and empty texts have no words, no labels
    and score 0; repeated rows are repeated; other columns are ignored.
    """
    scanner = Scanner(BASE if base is None else base, TEMPLATES if templates is None else templates)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def row(text):
        n, places, found = scanner.scan(text)
        starts = [s for s, _ in places]
        base_labels = sorted({scanner.phrases[p][1] for _, p in places})
        covered = _union([(s, s + len(scanner.phrases[p][0])) for s, p in places] + [(a, b) for _, a, b, _ in found])
        labels = sorted(set(base_labels) | {f[0] for f in found})
        spans = [{"label": x, "start": a, "end": b, "share": c} for x, a, b, c in found]
        return n, len(places), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(labels), covered / n if n else 0.0, spans

    def run(batches):
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
        for b in batches:
            cols = list(zip(*(row(t.as_py()) for t in b.column(1)))) or [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,share:double>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def _union(spans: list[tuple[int, int]]) -> int:
    """Words covered by at least one span."""
    total, reach = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def op5_licenses(docs: DataFrame) -> DataFrame:
    """The contract's digest."""
    out = scan_licenses(docs)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
