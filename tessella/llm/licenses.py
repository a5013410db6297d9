"""License scans: exact set-similarity join of text blocks with license templates.

Words
    ASCII letters lower-cased; a word is a run of ASCII letters, digits and
    characters above U+007F.

Base
    Places where a phrase's words stand consecutively.

Method
    A document holds a template if some ``width`` consecutive words (the
    template's length and a quarter) hold at least the share ``THRESHOLD`` of
    its distinct words.  Texts are cut into blocks of 2 * step words every step
    words, so each such window lies whole in some block; templates are dealt by
    length to steps of STEP, 2 * STEP, 4 * STEP, ... words, so they may have
    any length.  The words of all templates are ordered by their frequency in
    the whole corpus, rarest first, and the join of blocks with templates uses

    * length filter: a block with fewer than need = ceil(THRESHOLD * |T|)
      words of the vocabulary is left out;
    * prefix filter: in that order, one of the |T| - need + 1 first words of T
      is among the |B| - least + 1 first vocabulary words of a matching block
      B, least being the smallest need of any template of the step;
    * positional filter: if the first common word is at place i of T and at
      place j of B, at most min(|T| - i, |B| - j) words can be common; that has
      to reach need.

    Pairs that pass are counted exactly; ``scan(blocks=True)`` returns them all.
    In blocks that match, the windows are counted word by word.  Where another
    label's template R shares need or more of T's words, the window must also
    hold a word of T that R lacks, so the wording of one licence isn't reported
    as a neighbour's that shares most of it.  What is found doesn't depend on
    how blocks lie in a text.

    The templates are a fixed short list,
    so they and their frequencies can be broadcast whatever the corpus size.

Defined cases
    Null or empty text: no words, no labels, score 0.  Repeated rows: one
    result each.  Null doc_id stays null.  Empty table: no rows.  Extra columns
    are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import parts, small_batches, utf8

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Templates of notices and licence bodies: (label, words).
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
]
THRESHOLD, STEP = 0.8, 20
SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_templates long"
BLOCKS = "doc_id long, first_word long, label string, template string, n_common int, containment double"

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return utf8(text).translate(FOLD).split()


@dataclass(frozen=True)
class Template:
    label: str
    line: str
    words: tuple[bytes, ...]  # distinct, in the global order
    own: frozenset[bytes]
    need: int
    width: int
    apart: tuple[frozenset[bytes], ...]  # of each of these sets a window has to hold a word


class Step:
    """The templates whose windows fit into blocks of 2 * step words every step words."""

    def __init__(self, step: int):
        self.step, self.least, self.vocabulary = step, 0, frozenset()
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}

    def add(self, at: int, t: Template) -> None:
        self.least = min(self.least or t.need, t.need)
        self.vocabulary |= t.own
        for i, w in enumerate(t.words[: len(t.words) - t.need + 1]):
            self.prefix.setdefault(w, []).append((at, i))


class Matcher:
    """Templates in the global order of their words' frequencies."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float = THRESHOLD):
        sequences = [words(line) for _, line in templates]
        self.order = {w: i for i, w in enumerate(sorted({w for ws in sequences for w in ws}, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates: list[Template] = []
        self.steps: dict[int, Step] = {}
        self.rejected = 0  # by the positional filter
        for (label, line), ws in zip(templates, sequences, strict=True):
            own = frozenset(ws)
            need = max(1, math.ceil(threshold * len(own) - 1e-9))
            rivals = {own - frozenset(r) for (other, _), r in zip(templates, sequences, strict=True) if other != label and len(own & frozenset(r)) >= need}
            t = Template(label, line, tuple(sorted(own, key=self.order.__getitem__)), own, need, len(ws) + -(-len(ws) // 4), tuple(r for r in rivals if r))
            if not own:
                raise ValueError(f"the template {line!r} has no words")
            step = STEP
            while step < t.width:
                step *= 2
            self.steps.setdefault(step, Step(step)).add(len(self.templates), t)
            self.templates.append(t)
        self.rare = frozenset(w for s in self.steps.values() for w in s.prefix)

    def blocks(self, ws: list[bytes], known: set[bytes] | None = None):
        """(first word, words, template, common words) of each block and template over the threshold."""
        known = set(ws) if known is None else known
        if self.rare.isdisjoint(known):
            return
        for s in self.steps.values():
            hits = [i for i, w in enumerate(ws) if w in s.prefix]
            for b in sorted({k for i in hits for k in range(max(0, i // s.step - 1), i // s.step + 1)}):
                block = s.vocabulary.intersection(ws[b * s.step : (b + 2) * s.step])
                if len(block) < s.least:
                    continue
                ordered = sorted(block, key=self.order.__getitem__)
                seen: set[int] = set()
                for j, w in enumerate(ordered[: len(ordered) - s.least + 1]):
                    for at, i in s.prefix.get(w, ()):
                        if at in seen:
                            continue
                        seen.add(at)
                        t = self.templates[at]
                        if min(len(t.words) - i, len(ordered) - j) < t.need:
                            self.rejected += 1
                            continue
                        common = len(t.own & block)
                        if common >= t.need:
                            yield b * s.step, 2 * s.step, at, common

    def found(self, ws: list[bytes], known: set[bytes] | None = None) -> dict[int, int]:
        """template: words in common with the best of its windows, of the templates that the text holds."""
        out: dict[int, int] = {}
        for first, size, at, _ in self.blocks(ws, known):
            n = best_window(self.templates[at], ws[first : first + size])
            if n > out.get(at, 0):
                out[at] = n
        return out


def best_window(t: Template, ws: list[bytes]) -> int:
    """The most distinct words of t in one of its windows that has need of them and what tells t apart, else 0."""
    places = [(i, w) for i, w in enumerate(ws) if w in t.own]
    held: Counter = Counter()
    best = low = 0
    for i, w in places:
        held[w] += 1
        while places[low][0] <= i - t.width:
            left = places[low][1]
            held[left] -= 1
            if not held[left]:
                del held[left]
            low += 1
        if len(held) >= t.need and len(held) > best and all(not x.isdisjoint(held) for x in t.apart):
            best = len(held)
    return best


def base_places(ws: list[bytes], known: set[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every place of a base phrase."""
    out = []
    for phrase, label in PHRASES.items():
        own = phrase.encode().split()
        if known.issuperset(own):
            at = -1
            while True:
                try:
                    at = ws.index(own[0], at + 1)
                except ValueError:
                    break
                if ws[at : at + len(own)] == own:
                    out.append((at, label))
    return sorted(out)


def word_frequencies(docs: DataFrame, templates: list[tuple[str, str]] | None = None, text_col: str = "text") -> dict[bytes, int]:
    """In how many of all documents each word of the templates stands."""
    vocabulary = frozenset(w for _, line in templates or TEMPLATES for w in words(line))

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for own in parts(batch, 0):
                for text in own.column(0).to_pylist():
                    total.update(vocabulary.intersection(words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in sums.collect()}  # at most one row per template word


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, blocks: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document (SCAN), or with blocks one per matching block and template (BLOCKS)."""
    templates = templates or TEMPLATES
    small_batches(docs.sparkSession)
    frequency = word_frequencies(docs, templates, text_col)

    def run(batches):
        m = Matcher(templates, frequency, threshold)
        for batch in batches:
            for own in parts(batch, 1):
                rows = []
                for doc_id, text in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True):
                    ws = words(text)
                    known = set(ws)
                    if blocks:
                        rows += [(doc_id, at, m.templates[t].label, m.templates[t].line, n, n / len(m.templates[t].own)) for at, _, t, n in m.blocks(ws, known)]
                        continue
                    found = {m.templates[t]: n for t, n in m.found(ws, known).items()}
                    base = base_places(ws, known)
                    plain = sorted({label for _, label in base})
                    every = sorted({*plain, *(t.label for t in found)})
                    score = max([1.0 if base else 0.0, *(n / len(t.own) for t, n in found.items())])
                    rows.append((doc_id, len(ws), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(plain), ",".join(every), score, len(found)))
                yield _batch(rows, BLOCKS if blocks else SCAN)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, BLOCKS if blocks else SCAN)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*[part.split() for part in schema.split(", ")], strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(columns, types, strict=True)], names=list(names))
