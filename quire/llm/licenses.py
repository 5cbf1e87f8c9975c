"""License scans with a generalised suffix automaton.

The automaton holds every run of words of the license templates.  A text is streamed through it,
which gives for each word the longest run of template words that ends there (matching statistics).
Maximal matches of at least MIN_MATCH words are chained, for each template, in rising order of both
places; a chain that covers at least COVERED of its template is a span with the template's label.
Words that no template has end all matches, so only runs of template words are streamed.

Besides, base phrases are found wherever their words stand consecutively.

Defined results: null text is empty; a text without words has no span and null places; rows are
scanned one by one, so repeated rows and null ids need no care; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm import textblock as tb

MIN_MATCH, COVERED, MAX_GAP = 3, 0.6, 40

# Base phrases with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Labels and texts of license notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
)

IN_WORD = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def block_words(block: tb.Block) -> tuple[tb.Spans, np.ndarray]:
    data = tb.LOWER[block.data]
    words = tb.spans(block, IN_WORD[data])
    return words, tb.span_hashes(data, words.start, words.end)


def word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return block_words(tb.Block(0, raw, np.array([0, len(raw)])))[1]


class Automaton:
    """Generalised suffix automaton: a state stands for runs of words with the same ends."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [[]]
        for number, words in enumerate(texts):
            last = 0
            for place, word in enumerate(words):
                last = self._extend(last, word)
                at = last
                while at > 0:  # every run that ends here ends at this place of this template
                    self.ends[at].append((number, place + 1))
                    at = self.link[at]

    def _new(self, length: int, link: int, of: int | None = None) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append({} if of is None else dict(self.next[of]))
        self.ends.append([] if of is None else list(self.ends[of]))
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if (q := self.next[last].get(word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        state, p = self._new(self.length[last] + 1, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state

    def matches(self, words: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the maximal matches of at least `least` words."""
        state = length = 0
        for i, word in enumerate(words):
            if word not in self.next[state]:
                if length >= least:
                    yield i, length, state
                while state and word not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
            state = self.next[state].get(word, 0)
            length = length + 1 if state else 0
        if length >= least:
            yield len(words), length, state


class Scanner:
    def __init__(self, templates: tuple = TEMPLATES, phrases: tuple = PHRASES):
        hashed = [word_hashes(text) for _, text in templates]
        self.vocabulary = np.unique(np.concatenate(hashed))
        self.labels, self.sizes = [label for label, _ in templates], [len(x) for x in hashed]
        self.automaton = Automaton([np.searchsorted(self.vocabulary, x).tolist() for x in hashed])
        self.phrases = [(word_hashes(text), label) for text, label in phrases]

    def base(self, h: np.ndarray, doc: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """First words of all places of each phrase."""
        out = []
        for words, label in self.phrases:
            n = len(h) - len(words) + 1
            ok = np.zeros(0, bool)
            if n > 0:
                ok = doc[:n] == doc[len(words) - 1 :]
                for j, word in enumerate(words):
                    ok = ok & (h[j : j + n] == word)
            out.append((label, np.flatnonzero(ok)))
        return out

    def template_spans(self, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, str, int, int, float]]:
        """(document, label, first word, end, share of the template that is covered)."""
        known = np.searchsorted(self.vocabulary, h)
        known[known == len(self.vocabulary)] = 0
        inside = self.vocabulary[known] == h
        if not inside.any():
            return
        edge = np.ones(len(h) + 1, bool)
        edge[1:-1] = ~inside[1:] | ~inside[:-1] | (doc[1:] != doc[:-1])
        cuts = np.flatnonzero(edge)
        hits: dict[tuple[int, int], list] = {}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a >= MIN_MATCH and inside[a]:
                for end, length, state in self.automaton.matches(known[a:b].tolist(), MIN_MATCH):
                    for template, place in self.automaton.ends[state]:
                        hits.setdefault((int(doc[a]), template), []).append((int(a) + end - length, int(a) + end, place - length, place))
        for (d, template), found in hits.items():
            for first, end, covered in chains(found):
                if covered >= COVERED * self.sizes[template]:
                    yield d, self.labels[template], first, end, min(1.0, covered / self.sizes[template])


def chains(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(first word, end, template words covered) of the best chains of matches of one template.

    A match follows another if it starts and ends later in both the text and the template, at most
    MAX_GAP words behind it; of overlapping matches only the new words count."""
    found.sort()
    best: list[list[int]] = []
    for i, (a, b, p, q) in enumerate(found):
        one = [b - a, a, -1]
        for j in range(i - 1, -1, -1):
            a2, b2, p2, q2 = found[j]
            if a - b2 > MAX_GAP:
                break
            gain = min(b - max(a, b2), q - max(p, q2))
            if b > b2 and q > q2 and gain > 0 and best[j][0] + gain > one[0]:
                one = [best[j][0] + gain, best[j][1], j]
        best.append(one)
    inner = {x[2] for x in best}
    return [(x[1], found[i][1], x[0]) for i, x in enumerate(best) if i not in inner]


@lru_cache(1)
def scanner() -> Scanner:
    """One scanner for each worker process."""
    return Scanner()


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, base and spans of every row; places count words from 0, ends are exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner()
        for batch in batches:
            for block in tb.blocks(batch.column(text)):
                words, h = block_words(block)
                counts = words.counts(block.n)
                first = np.cumsum(counts) - counts
                base: list[list[dict]] = [[] for _ in range(block.n)]
                for label, at in own.base(h, words.doc):
                    for i in at.tolist():
                        d = words.doc[i]
                        base[d].append({"label": label, "first_word": int(i - first[d])})
                spans: list[list[dict]] = [[] for _ in range(block.n)]
                for d, label, a, b, covered in own.template_spans(h, words.doc):
                    spans[d].append({"label": label, "first_word": int(a - first[d]), "end_word": int(b - first[d]), "covered": covered})
                place = pa.struct([("label", pa.string()), ("first_word", pa.int64())])
                span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.float64())])
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(block.first, block.n), pa.array(counts), pa.array(base, pa.list_(place)), pa.array(spans, pa.list_(span))], [key, "n_words", "base", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_words long, base array<struct<label:string,first_word:bigint>>, spans array<struct<label:string,first_word:bigint,end_word:bigint,covered:double>>")
