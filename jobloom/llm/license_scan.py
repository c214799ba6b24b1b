"""License scans by template markup compiled to token automata.

A template is wording with two kinds of markup: ``[[ ... ]]`` may be left out, and ``{{n}}`` stands for up to n
words of any kind (names, years). Both compile to an automaton over words; all templates share one, made
deterministic as texts ask for it. A template matches where its mandatory words stand one after the other exactly,
with optional regions present or absent and replaceable ones filled. Single phrases are templates without markup.

Words are what ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` finds after A-Z are lower-cased.

Edge cases: a null or empty text has no words, no labels and score 0; several templates may match at one place and
all count; ids may be null or repeated; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import slices, small_batches, whole_text

#: Phrases that count as base matches, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Templates of notices, with their labels.
TEMPLATES = (
    ("licensed under [[the]] apache license [[version]] 2 [[0]]", "apache-2.0"),
    (
        "licensed under the apache license version 2 0 the license you may not use this [[file|work]] except in compliance with the license "
        "[[you may obtain a copy of the license at {{8}}]] unless required by applicable law or agreed to in writing software distributed under "
        "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "apache-2.0-notice",
    ),
    ("released under [[the terms of]] [[the]] mit license", "mit-declared"),
    ("licensed under [[the terms of]] [[the]] mit license", "mit-declared"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "[[the software]] to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in "
        "all copies or substantial portions of the software",
        "mit-notice",
    ),
    ("licensed under [[the terms of]] the [[gnu]] general public license [[as published by the free software foundation]] [[either]] version 2", "gpl-2.0"),
    ("licensed under [[the terms of]] the [[gnu]] general public license [[as published by the free software foundation]] [[either]] version 3", "gpl-3.0"),
    (
        "is free software you can redistribute it and or modify it under the terms of the gnu {{1}} general public license as published by the "
        "free software foundation either version {{2}} of the license or at your option any later version",
        "gpl-notice",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "bsd-notice",
    ),
    (
        "neither the name of {{12}} nor the names of [[its]] contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission",
        "bsd-3-clause",
    ),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-notice"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0-notice"),
    ("licensed under [[a]] [[creative commons]] cc by nc [[sa]] 4 0", "cc-by-nc-4.0"),
    ("licensed under [[a]] [[creative commons]] cc by [[sa]] 4 0", "cc-by-4.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

_MARKUP = re.compile(r"\[\[|\]\]|\||\{\{\d+\}\}|[0-9a-z]+")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass
class Automaton:
    """States with edges by word, by any word (None), and without a word; accepting states name (label, is base)."""

    words: list[dict[bytes, set[int]]] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)
    silent: list[set[int]] = field(default_factory=list)
    accepts: dict[int, tuple[str, bool]] = field(default_factory=dict)
    starts: list[int] = field(default_factory=list)

    def state(self) -> int:
        self.words.append({})
        self.free.append(set())
        self.silent.append(set())
        return len(self.words) - 1

    def add(self, template: str, label: str, base: bool = False) -> None:
        """Compiles one template."""
        at = self.state()
        self.starts.append(at)
        open_regions: list[tuple[int, list[int]]] = []
        for mark in _MARKUP.findall(template):
            if mark == "[[":
                open_regions.append((at, []))
                into = self.state()
                self.silent[at].add(into)
                at = into
            elif mark == "|":  # another wording of the region
                begin, ends = open_regions[-1]
                ends.append(at)
                at = self.state()
                self.silent[begin].add(at)
            elif mark == "]]":
                begin, ends = open_regions.pop()
                out = self.state()
                for end in (*ends, at, begin):
                    self.silent[end].add(out)
                at = out
            elif mark[0] == "{":
                out = self.state()
                for _ in range(int(mark[2:-2])):
                    self.silent[at].add(out)
                    after = self.state()
                    self.free[at].add(after)
                    at = after
                self.silent[at].add(out)
                at = out
            else:
                after = self.state()
                self.words[at].setdefault(mark.encode(), set()).add(after)
                at = after
        if open_regions:
            raise ValueError(f"unclosed region in {template!r}")
        self.accepts[at] = (label, base)

    def closed(self, states: set[int]) -> frozenset[int]:
        """With what is reached without a word."""
        todo, seen = list(states), set(states)
        while todo:
            for s in self.silent[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)


class Scanner:
    """The automaton, made deterministic step by step, and its matches in word lists."""

    def __init__(self, templates=TEMPLATES, phrases=BASE):
        auto = Automaton()
        for phrase, label in phrases:
            auto.add(phrase, label, True)
        for template, label in templates:
            auto.add(template, label)
        self.auto = auto
        self.start = auto.closed(set(auto.starts))
        if any(auto.free[s] for s in self.start) or self.start & auto.accepts.keys():
            raise ValueError("a template must begin with a word")
        self.first = {w for s in self.start for w in auto.words[s]}
        self.vocabulary = {w for d in auto.words for w in d}
        self.steps: dict[tuple[frozenset[int], bytes | None], frozenset[int]] = {}
        self.names: dict[frozenset[int], list[tuple[str, bool]]] = {}

    def step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        key = (states, word if word in self.vocabulary else None)
        if key not in self.steps:
            to = set().union(*(self.auto.words[s].get(word, ()) for s in states), *(self.auto.free[s] for s in states))
            self.steps[key] = reached = self.auto.closed(to)
            self.names[reached] = [self.auto.accepts[s] for s in sorted(reached & self.auto.accepts.keys())]
        return self.steps[key]

    def matches(self, words: list[bytes]) -> list[tuple[int, int, str, bool]]:
        """(first word, word after the last, label, is base): the longest match of each label at each place."""
        found = []
        first = self.first
        for i in [i for i, w in enumerate(words) if w in first]:
            states, best = self.start, {}
            for j in range(i, len(words)):
                states = self.step(states, words[j])
                if not states:
                    break
                for name in self.names[states]:
                    best[name] = j + 1
            found += [(i, end, *name) for name, end in sorted(best.items())]
        return found


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8; bytes.lower() changes A-Z only."""
    return _WORD.findall(text.encode().lower())


def scan_text(scanner: Scanner, text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    words = words_of(text)
    found = scanner.matches(words)
    base = [m for m in found if m[3]]
    covered, reach = 0, 0
    for a, b, *_ in sorted(found):
        covered += max(0, b - max(a, reach))
        reach = max(reach, b)
    return (
        len(words),
        len(base),
        min((m[0] for m in base), default=None),
        max((m[0] for m in base), default=None),
        ",".join(sorted({m[2] for m in base})),
        ",".join(sorted({m[2] for m in found})),
        covered / len(words) if words else 0.0,
        ",".join(f"{label}:{a}:{b}" for a, b, label, _ in found),
    )


def scan(docs: DataFrame, templates=TEMPLATES, phrases=BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``; spans are label:first word:word after the last."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in slices(batches):
            rows = [scan_text(scanner, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, schema)
