"""License scans with a generalised suffix automaton of licence words.

The automaton holds every run of words of every template. Going over a text
word by word gives its matching statistics: the longest run that ends at a word
and occurs in a template. Phrases are found where their state is reached; runs
of ``MIN_MATCH`` words and more that cannot be extended are chained, in the
order of both text and template, into the spans that a template covers, small
changes and omissions between them allowed.

Words outside the templates, and neighbours that never stand next to each other
in one, end every run; this is looked up for all words of a batch at once, and
the automaton only walks the runs between.

A null or empty text has no words, places or labels and score 0. Texts of any
length are read whole, one after the other. Rows are judged each on its own;
columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioseek.llm.common import byte_class, slices, tokens

# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# The public notices by which works carry these licences, and their labels.
TEMPLATES = (
    (
        "mit-notice",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "apache-2.0-notice",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    (
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details.",
    ),
    (
        "bsd-notice",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
    (
        "mpl-2.0-notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("mit-line", "Released under the MIT License."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
WORD = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)))
MIN_MATCH = 4
MAX_GAP = 12
MIN_COVERAGE = 0.7


class SuffixAutomaton:
    """All runs of words of some templates, each state with the places in templates where its runs end."""

    def __init__(self, templates: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, template in enumerate(templates):
            last = 0
            for place, word in enumerate(template):
                last = self._extend(last, word)
                self.ends[last].add((number, place))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] |= self.ends[state]

    def _add(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, state: int, word: int) -> int:
        """The state for the run of ``state`` and ``word`` alone, apart from longer runs that end alike."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._add(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._add(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        self.link[new] = 0 if last < 0 else self._split(last, word)
        return new

    def state_of(self, run: Sequence[int]) -> int:
        state = 0
        for word in run:
            state = self.next[state][word]
        return state

    def statistics(self, run: Sequence[int]) -> Iterator[tuple[int, int]]:
        """For each word the state and length of the longest run that ends there."""
        state = length = 0
        for word in run:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield state, length


class Scanner:
    """Templates and phrases made ready to scan texts."""

    def __init__(self, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES):
        found = tokens(pa.array([text for _, text in templates] + [phrase for phrase, _ in phrases]), WORD)
        runs = [found.of(i).tolist() for i in range(len(templates) + len(phrases))]
        self.words = {word: i for i, word in enumerate(found.distinct.to_pylist())}
        self.labels = [label for label, _ in templates]
        self.sizes = [len(run) for run in runs[: len(templates)]]
        self.automaton = SuffixAutomaton(runs)
        self.phrase_labels = [label for _, label in phrases]
        own: dict[int, list[tuple[int, int]]] = {}
        for number, run in enumerate(runs[len(templates) :]):
            own.setdefault(self.automaton.state_of(run), []).append((number, len(run)))
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.automaton.link]
        for state in sorted(range(1, len(self.automaton.link)), key=lambda s: self.automaton.length[s]):
            self.phrases[state] = own.get(state, []) + self.phrases[self.automaton.link[state]]
        self.follows = np.zeros((len(self.words), len(self.words)), dtype=bool)
        self.alone = np.zeros(len(self.words), dtype=bool)
        for run in runs:
            self.follows[run[:-1], run[1:]] = True
            if len(run) == 1:
                self.alone[run[0]] = True

    def runs(self, ids: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Start and words of the parts of a text that may hold more than single words of templates."""
        if not len(ids):
            return
        known = ids >= 0
        joined = np.zeros(len(ids) + 1, dtype=bool)
        places = np.flatnonzero(known[:-1] & known[1:])
        joined[places + 1] = self.follows[ids[places], ids[places + 1]]
        wanted = joined[:-1] | joined[1:]
        wanted[known] |= self.alone[ids[known]]
        starts = np.flatnonzero(wanted & ~joined[:-1])
        ends = np.flatnonzero(wanted & ~joined[1:]) + 1
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            yield start, ids[start:end].tolist()

    def scan(self, ids: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
        """Places of phrases ``(phrase, start, end)`` and long matches ``(start, end, state)`` of a text."""
        places, matches = [], []
        for start, run in self.runs(ids):
            before = (0, 0)
            for offset, (state, length) in enumerate(self.automaton.statistics(run)):
                at = start + offset
                for number, size in self.phrases[state]:
                    if size <= length:
                        places.append((number, at + 1 - size, at + 1))
                if length <= before[1] and before[1] >= MIN_MATCH:
                    matches.append((at - before[1], at, before[0]))
                before = (state, length)
            if before[1] >= MIN_MATCH:
                end = start + len(run)
                matches.append((end - before[1], end, before[0]))
        return places, matches

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Chains ``(template, start, end, coverage)`` of long matches; a chain moves on in text and template.

        A match joins the chain that ends last before it, in text and template,
        by no more than ``MAX_GAP`` words in either; its words are counted once.
        """
        open_chains: dict[int, list[list[int]]] = {}
        done = []
        for start, end, state in matches:
            for template, last in self.automaton.ends[state]:
                if template >= len(self.sizes):
                    continue
                at = last + 1 - (end - start)
                chains = open_chains.setdefault(template, [])
                for chain in [c for c in chains if start - c[1] > MAX_GAP]:
                    done.append((template, chain[0], chain[1], chain[3]))
                    chains.remove(chain)
                best = None
                for chain in chains:
                    if chain[1] < end and chain[2] < last + 1 and at - chain[2] <= MAX_GAP and at > chain[4]:
                        best = chain if best is None or chain[3] > best[3] else best
                if best is None:
                    chains.append([start, end, last + 1, end - start, at])
                else:
                    new = min(end - max(start, best[1]), last + 1 - max(at, best[2]))
                    best[1:] = [end, last + 1, best[3] + new, at]
        done += [(template, c[0], c[1], c[3]) for template, chains in open_chains.items() for c in chains]
        return [(t, start, end, min(1.0, covered / self.sizes[t])) for t, start, end, covered in sorted(done)]


RESULT = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))),
    ]
)


def judged(ids: np.ndarray, scanner: Scanner) -> tuple:
    """A row of ``RESULT``: score is the greatest coverage of a template, labels are those of phrases and covered templates."""
    places, matches = scanner.scan(ids)
    spans = [s for s in scanner.spans(matches) if s[3] >= MIN_COVERAGE] if matches else []
    score = max((s[3] for s in scanner.spans(matches)), default=0.0) if matches else 0.0
    starts = [start for _, start, _ in places]
    base = {scanner.phrase_labels[number] for number, _, _ in places}
    labels = base | {scanner.labels[template] for template, *_ in spans}
    return (
        len(ids),
        len(places),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        score,
        [{"label": scanner.labels[t], "start": start, "end": end, "coverage": c} for t, start, end, c in spans],
    )


def _scan(phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in slices(batches):
            found = tokens(batch.column("text"), WORD)
            lookup = np.array([scanner.words.get(word, -1) for word in found.distinct.to_pylist()] or [-1], dtype=np.int64)
            ids = lookup[found.codes]
            rows = [judged(ids[found.starts[i] : found.starts[i + 1]], scanner) for i in range(batch.num_rows)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RESULT.types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *RESULT.names])

    return scan


def scanned(documents: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """For each row of ``documents(doc_id, text)`` the places, labels, score and covered spans (in words)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string,"
        " score double, spans array<struct<label string, start bigint, end bigint, coverage double>>"
    )
    return documents.select("doc_id", "text").mapInArrow(_scan(phrases, templates), schema)
