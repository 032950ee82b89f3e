"""Licence scan with a generalised suffix automaton of licence tokens.

The automaton holds every substring of all templates.  A text is streamed through it word by word, which gives its matching
statistics: at each word the length of the longest suffix that is a substring of some template, and the state, which
knows where in which templates.  Matches of at least ``MIN_MATCH`` words that cannot be extended are chained: forward in both
text and template, with a gap of at most ``MAX_GAP`` words.  A template whose chain covers enough of it gives its label.  A text
may hold many notices: of the chains that cover enough of a template, those stay that together cover most words without overlap.  Templates
compete for a span: the chain that covers most words has it, then the one with fewest words inserted and left out; another template's
chain that lies in it by more than half is dropped.  Words that tell a family from its neighbours must stand in the span.
Phrases are templates too: all their places are read from the states (a phrase ends where its state is an ancestor of the current one).

The automaton has some thousand states, fixed by the templates, and is built once per worker.  Words outside the templates reset it,
so runs of them are skipped.

Defined results: a null or empty text has no words, no labels and score 0.  Null ids, repeated rows and extra columns pass.  An empty
table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from clickwright.llm.common import ship, text_of

MIN_MATCH, MAX_GAP, MIN_COVER, MIN_WORDS = 4, 24, 0.6, 10

#: fixed values: phrase -> label
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: fixed values: label, or label/part -> words of public licence notices
TEMPLATES = {
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
        files the software to deal in the software without restriction including without limitation the rights to use copy modify merge
        publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so""",
    "apache-2": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
        you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in
        writing software distributed under the license is distributed on an as is basis""",
    "bsd": """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the
        following disclaimer""",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
        that the above copyright notice and this permission notice appear in all copies""",
    "gpl-3": """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as
        published by the free software foundation either version 3 of the license or at your option any later version""",
    "gpl-2": """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as
        published by the free software foundation either version 2 of the license or at your option any later version""",
    "lgpl": """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public
        license as published by the free software foundation""",
    "lgpl/3": """this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
        as published by the free software foundation either version 3 of the license or at your option any later version""",
    "agpl-3": """this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
        as published by the free software foundation either version 3 of the license or at your option any later version""",
    "gfdl": """permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
        version 1 3 or any later version published by the free software foundation with no invariant sections no front cover texts and no
        back cover texts""",
    "mpl-2": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed
        with this file you can obtain one at http mozilla org mpl 2 0""",
    "mpl-1.1": """the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except
        in compliance with the license you may obtain a copy of the license at http www mozilla org mpl""",
    "epl-1": """all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license
        v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html""",
    "epl-2": """this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is
        available at https www eclipse org legal epl 2 0""",
    "cddl": """the contents of this file are subject to the terms of the common development and distribution license the license you may not
        use this file except in compliance with the license""",
    "eupl": """licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl
        the licence you may not use this work except in compliance with the licence""",
    "ofl": "this font software is licensed under the sil open font license version 1 1 this license is copied below and is also available with a faq at",
    "osl-3": "licensed under the open software license version 3 0",
    "afl-3": "licensed under the academic free license version 3 0",
    "zlib": """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
        arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
        applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be
        misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the
        product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be
        misrepresented as being the original software this notice may not be removed or altered from any source distribution""",
    "bsl-1": """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare
        derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following""",
    "unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
        distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""",
    "unlicense/dedication": """in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright
        interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our
        heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
        software under copyright law""",
    "wtfpl": """everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as
        long as the name is changed""",
    "postgresql": """permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a
        written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear
        in all copies""",
    "isc/openbsd": """permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided
        that the above copyright notice and this permission notice appear in all copies""",
    "isc/warranty": """the software is provided as is and the author disclaims all warranties with regard to this software including all implied
        warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages
        or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action
        arising out of or in connection with the use or performance of this software""",
    "mit/rest": """the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
        merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any
        claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software
        or the use or other dealings in the software""",
    "bsd-2": """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the
        following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
        disclaimer in the documentation and or other materials provided with the distribution""",
    "bsd-3/clause": """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission""",
    "cc0": """to the extent possible under law the author has waived all copyright and related or neighboring rights to this work""",
    "all-rights-reserved": "all rights reserved no part of this publication may be reproduced without the prior written permission of the publisher",
}

TEMPLATES["mit/whole"] = f"{TEMPLATES['mit']} subject to the following conditions {TEMPLATES['mit/rest']}"
TEMPLATES["bsd-3"] = f"{TEMPLATES['bsd-2']} {TEMPLATES['bsd-3/clause']}"

#: words that must stand in a template's span
REQUIRED = {"agpl-3": "affero", "lgpl": "lesser", "lgpl/3": "lesser", "mit/rest": "substantial", "epl-1": "eclipse", "epl-2": "eclipse", "cddl": "development",
            "bsd-3": "endorse", "isc/warranty": "author", "osl-3": "open", "afl-3": "academic", "gfdl": "documentation", "mpl-1.1": "mozilla", "postgresql": "paragraph"}

#: Creative Commons: the parts of each licence, and their words in version 4.0 and before
CC = {"": "", "-sa": "sharealike", "-nc": "noncommercial", "-nd": "noderivatives", "-nc-sa": "noncommercial sharealike", "-nc-nd": "noncommercial noderivatives"}
for _part, _words in CC.items():
    _old = _words.replace("noderivatives", "noderivs")
    TEMPLATES[f"cc-by{_part}"] = f"this work is licensed under a creative commons attribution {_words} 4 0 international license"
    TEMPLATES[f"cc-by{_part}/3"] = f"this work is licensed under a creative commons attribution {_old} 3 0 unported license"
    REQUIRED |= {f"cc-by{_part}": _words, f"cc-by{_part}/3": _old}

_SPACES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words: runs of 0-9, a-z and everything beyond ASCII, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_SPACES).split()


class Automaton:
    """Generalised suffix automaton over word ids of several sequences."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for k, seq in enumerate(sequences):
            last = 0
            for i, w in enumerate(seq):
                last = self._extend(last, w, ends)
                ends[last].add((k, i + 1))
        for v in sorted(range(1, len(self.size)), key=lambda v: -self.size[v]):
            ends[self.link[v]] |= ends[v]
        self.ends = [sorted(e) for e in ends]

    def _state(self, size: int, edges: dict[int, int], link: int, ends: list) -> int:
        self.size.append(size)
        self.next.append(edges)
        self.link.append(link)
        ends.append(set())
        return len(self.size) - 1

    def _split(self, p: int, w: int, q: int, ends: list) -> int:
        """The state of the longest string of p followed by w; q, where it leads now, is divided if it holds longer ones."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q], ends)
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int, ends: list) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w], ends)
        new = self._state(self.size[last] + 1, {}, 0, ends)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w], ends)
        return new

    def statistics(self, ids: list[int], base: int = 0) -> Iterator[tuple[int, int, int]]:
        """(index of the word, match length, state) for each word."""
        v = n = 0
        for i, w in enumerate(ids, base):
            while v and w not in self.next[v]:
                v = self.link[v]
                n = self.size[v]
            if w in self.next[v]:
                v, n = self.next[v][w], n + 1
            yield i, n, v


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str], required: dict[str, str]) -> None:
        named = [(label, text.split()) for label, text in templates.items()]
        self.phrases = [(phrase.split(), label) for phrase, label in phrases.items()]
        all_words = [t for _, t in named] + [p for p, _ in self.phrases]
        self.ids = {w.encode(): i for i, w in enumerate(sorted({w for t in all_words for w in t}), 1)}
        self.labels, self.lengths = [key.split("/")[0] for key, _ in named], [len(t) for _, t in named]
        self.required = [{self.ids[w.encode()] for w in required.get(key, "").split()} for key, _ in named]
        self.automaton = a = Automaton([[self.ids[w.encode()] for w in t] for t in all_words])
        at: dict[int, list[int]] = {}
        for k, (phrase, _) in enumerate(self.phrases):
            v = 0
            for w in phrase:
                v = a.next[v][self.ids[w.encode()]]
            at.setdefault(v, []).append(k)
        self.ending: list[list[int]] = [[]] * len(a.size)
        for v in sorted(range(1, len(a.size)), key=lambda v: a.size[v]):
            self.ending[v] = self.ending[a.link[v]] + at.get(v, [])
        self.least = min([MIN_MATCH, *(len(p) for p, _ in self.phrases)])

    def scan(self, words: list[bytes]) -> dict:
        """places of phrases [(start, label)], spans [(label, first, end, cover)], score: the highest cover of any chain."""
        ids = list(map(self.ids.get, words))
        places: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int]] = []  # start, end, state
        i, n = 0, len(ids)
        while i < n:
            if ids[i] is None:
                i += 1
                continue
            j = i
            while j < n and ids[j] is not None:
                j += 1
            if j - i >= self.least:
                before = (0, 0, 0)
                for at, size, v in self.automaton.statistics(ids[i:j], i):
                    for k in self.ending[v]:
                        m = len(self.phrases[k][0])
                        if size >= m:
                            places.append((at + 1 - m, self.phrases[k][1]))
                    if before[1] >= MIN_MATCH and size <= before[1]:
                        matches.append((before[0] + 1 - before[1], before[0] + 1, before[2]))
                    before = (at, size, v)
                if before[1] >= MIN_MATCH:
                    matches.append((before[0] + 1 - before[1], before[0] + 1, before[2]))
            i = j
        chains = self._chains(matches)
        apart = [(k, *x) for k, found in chains.items() for x in self._apart(k, found, ids)]
        spans = [(self.labels[k], first, end, own / self.lengths[k]) for k, first, end, own in self._compete(apart)]
        return {"places": places, "spans": spans, "score": max((own / self.lengths[k] for k, x in chains.items() for _, _, own in x), default=0.0)}

    def _chains(self, matches: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
        """The chains of each template as (first word, end, words covered), by end.

        Of the chains to one place those stay that cover more words than all that start later, so at most a template's length of them.
        """
        chains: dict[int, list[tuple[int, int, int]]] = {}
        near: dict[int, deque] = {}
        for start, end, v in matches:
            fresh: dict[int, list] = {}
            for k, stop in self.automaton.ends[v]:
                if k >= len(self.labels):
                    continue
                most = {start: end - start}
                for s2, e2, stop2, before in near.get(k, ()):
                    gain = min(end - max(start, e2), stop - max(stop - (end - start), stop2))
                    if gain > 0 and start - e2 <= MAX_GAP and e2 <= end and stop2 <= stop:
                        for first, own in before:
                            most[first] = max(most.get(first, 0), own + gain)
                kept: list[tuple[int, int]] = []
                for first in sorted(most, reverse=True):
                    if not kept or most[first] > kept[-1][1]:
                        kept.append((first, most[first]))
                fresh.setdefault(k, []).append((start, end, stop, kept))
                chains.setdefault(k, []).extend((first, end, own) for first, own in kept)
            for k, rows in fresh.items():
                recent = near.setdefault(k, deque())
                recent.extend(rows)
                while recent and start - recent[0][1] > MAX_GAP:
                    recent.popleft()
        return chains

    def _apart(self, k: int, chains: list[tuple[int, int, int]], ids: list[int]) -> list[tuple[int, int, int]]:
        """Those of template k's chains that cover enough of it and have its required words, without overlap and with the most words in all."""
        enough = [x for x in chains if x[2] >= min(MIN_WORDS, self.lengths[k]) and x[2] / self.lengths[k] >= MIN_COVER]
        if self.required[k]:
            enough = [x for x in enough if self.required[k].issubset(ids[x[0] : x[1]])]
        ends, best = [x[1] for x in enough], [0]
        before = [bisect_right(ends, first, 0, i) for i, (first, _, _) in enumerate(enough)]
        for i, (_, _, own) in enumerate(enough):
            best.append(max(best[i], best[before[i]] + own))
        out, i = [], len(enough)
        while i:
            if best[i] > best[i - 1]:
                out.append(enough[i - 1])
                i = before[i - 1]
            else:
                i -= 1
        return out


    def _compete(self, spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Of (template, first, end, words covered) the best of those that share most of their words, by first word."""

        def worse(x):
            k, first, end, own = x
            return -own, (end - first - own) + (self.lengths[k] - own), first, self.labels[k], k

        taken = bytearray(max((x[2] for x in spans), default=0))
        won = []
        for x in sorted(spans, key=worse):
            first, end = x[1], x[2]
            if 2 * taken.count(1, first, end) <= end - first:
                taken[first:end] = b"\x01" * (end - first)
                won.append(x)
        return sorted(won, key=lambda x: x[1:])


@lru_cache(maxsize=4)
def _scanner(templates: tuple, phrases: tuple, required: tuple) -> Scanner:
    return Scanner(dict(templates), dict(phrases), dict(required))


FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    required: dict[str, str] = REQUIRED,
) -> DataFrame:
    """One row per document: doc_id, counts and places of phrases, labels, score, spans (label:first:end:cover of each notice)."""
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    key = tuple(templates.items()), tuple(phrases.items()), tuple(required.items())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*key)
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text in b.column(1):
                words = words_of(text.as_py())
                got = scanner.scan(words)
                places = [p for p, _ in got["places"]]
                base = {label for _, label in got["places"]}
                spans = got["spans"]
                score = 1.0 if base else got["score"]
                row = (
                    len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | {s[0] for s in spans})), score, ",".join(f"{s[0]}:{s[1]}:{s[2]}:{s[3]:.3f}" for s in sorted(spans)),
                )
                for c, x in zip(cols, row):
                    c.append(x)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            names = [x.split()[0] for x in FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", *names])

    return docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("t")).mapInArrow(of, f"doc_id {id_type}, {FOUND}")
