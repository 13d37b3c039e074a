"""License scans by template-markup matching.

A template is wording with regions marked ``[[ ... | ... ]]`` (optional, with alternatives)
and ``<<n>>`` (replaceable by at most n words), nested as deep as need be.
``compile_template`` turns it into a token automaton; a text is accepted where its words
run from the start to the end state, so all mandatory wording matches word for word.  Texts are lower-cased (A-Z) and
split into words, so layout and punctuation never matter.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, strings, text_rows

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Wording of public licenses and their notices.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license [[,]] version 2.0 [[(the license)]]"),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("mit", "[[released | licensed | available]] under the [[terms of the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "[[licensed]] under the [[terms of the]] gnu [[lesser | affero]] general public license [[as published by the free software foundation]] [[either]] [[version <<1>>]] [[or later]]"),
    ("gpl-3", "gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("gpl-2", "gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("lgpl", "gnu lesser general public license [[version <<2>>]]"),
    ("lgpl", "gnu library general public license [[version <<2>>]]"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "[[released | licensed]] under the [[<<1>> clause]] bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "[[licensed]] under [[a | the]] creative commons attribution [[<<1>>]] [[international | unported]] license"),
    ("cc-by-nc", "cc by nc [[4.0 | 3.0 | 2.0]]"),
    ("cc-by-sa", "cc by sa [[4.0 | 3.0 | 2.0]]"),
    ("cc-by-nd", "cc by nd [[4.0 | 3.0 | 2.0]]"),
    ("mpl-2.0", "subject to the terms of the mozilla public license [[v | version]] 2.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("copyright", "copyright [[c]] <<4>> all rights reserved"),
)

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MARKUP = re.compile(r"\[\[|\]\]|\||<<(\d+)>>|([^\[\]|<>]+)")


def words(text: str) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


@dataclass(frozen=True)
class Automaton:
    """States 0..last over words.  ``step[s]`` maps a word to next states, ``any[s]`` lists states that any word leads to.

    ``anchor`` is the longest run of mandatory words; at most ``before`` words stand in front of it.
    """

    label: str
    step: tuple[dict[bytes, tuple[int, ...]], ...]
    any: tuple[tuple[int, ...], ...]
    start: frozenset[int]
    accept: frozenset[int]
    anchor: tuple[bytes, ...]
    before: int

    def match(self, tokens: Sequence[bytes], at: int) -> int:
        """End of the longest accepted run of words that begins at ``at``, or -1."""
        states, best = self.start, -1
        for i in range(at, len(tokens)):
            states = frozenset(t for s in states for t in (*self.step[s].get(tokens[i], ()), *self.any[s]))
            if not states:
                break
            if states & self.accept:
                best = i + 1
        return best


def compile_template(label: str, markup: str) -> Automaton:
    """Compile one template; empty moves past optional and replaceable regions are closed here.

    Markup whose brackets do not match, or without mandatory wording, is an error.
    """
    marks = [(m.group(), m[1]) for m in _MARKUP.finditer(markup)]
    edges: list[tuple[int, bytes | None, int]] = []
    skips: list[tuple[int, int]] = []
    runs: list[tuple[int, list[bytes]]] = [(0, [])]  # mandatory wording, each with the state before it
    longest = [0]  # words on the longest way to each state

    def new(*sources: int, words: int = 0) -> int:
        longest.append(max(longest[s] for s in sources) + words)
        return len(longest) - 1

    def sequence(at: int, state: int, depth: int) -> tuple[int, int]:
        """Compile from mark ``at`` on, up to the end of the region; returns where it ends and the state there."""
        while at < len(marks):
            mark, most = marks[at]
            if mark in ("|", "]]"):
                break
            if mark == "[[":
                entry, ends = state, [state]
                while mark != "]]":
                    at, end = sequence(at + 1, entry, depth + 1)
                    ends.append(end)
                    if at == len(marks):
                        raise ValueError(f"template {label!r}: [[ without ]]")
                    mark = marks[at][0]
                state = new(*ends)
                skips.extend((s, state) for s in ends)
            elif most:
                ends = [state]
                for _ in range(int(most)):
                    ends.append(new(ends[-1], words=1))
                    edges.append((ends[-2], None, ends[-1]))
                state = new(*ends)
                skips.extend((s, state) for s in ends)
            else:
                for word in words(mark):
                    edges.append((state, word, new(state, words=1)))
                    state = edges[-1][2]
                    if not depth:
                        runs[-1][1].append(word)
                at += 1
                continue
            if not depth:
                runs.append((state, []))
            at += 1
        return at, state

    at, last = sequence(0, 0, 0)
    if at < len(marks):
        raise ValueError(f"template {label!r}: {marks[at][0]} outside of a region")
    onward: dict[int, list[int]] = {}
    for a, b in skips:
        onward.setdefault(a, []).append(b)

    def closed(state: int) -> set[int]:
        found, waiting = {state}, [state]
        while waiting:
            for b in onward.get(waiting.pop(), ()):
                if b not in found:
                    found.add(b)
                    waiting.append(b)
        return found

    close = [closed(s) for s in range(len(longest))]
    step: list[dict[bytes, set[int]]] = [{} for _ in close]
    anyword: list[set[int]] = [set() for _ in close]
    for a, word, b in edges:
        if word is None:
            anyword[a] |= close[b]
        else:
            step[a].setdefault(word, set()).update(close[b])
    start, anchor = max(runs, key=lambda r: len(r[1]))
    if not anchor:
        raise ValueError(f"template {label!r} has no mandatory wording")
    return Automaton(label, tuple({w: tuple(t) for w, t in x.items()} for x in step), tuple(map(tuple, anyword)), frozenset(close[0]), frozenset(s for s, c in enumerate(close) if last in c), tuple(anchor), longest[start])


class Scanner:
    """All templates; finds where each accepts, longest first, not overlapping itself."""

    def __init__(self, base: Sequence[tuple[str, str]] = BASE, templates: Sequence[tuple[str, str]] = TEMPLATES):
        self.base = [(b" " + b" ".join(a.anchor) + b" ", a) for a in (compile_template(label, phrase) for phrase, label in base)]
        self.templates = [(b" " + b" ".join(a.anchor) + b" ", a) for a in (compile_template(label, markup) for label, markup in templates)]

    @staticmethod
    def _places(anchor: bytes, line: bytes) -> list[int]:
        """Word numbers at which the anchor's words stand."""
        places, word, last = [], 0, 0
        at = line.find(anchor)
        while at >= 0:
            word += line.count(b" ", last, at)
            places.append(word)
            last, at = at, line.find(anchor, at + 1)
        return places

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Number of words; base places and template spans as (first word, end, label)."""
        tokens = words(text)
        line = b" " + b" ".join(tokens) + b" "
        base = [(at, at + len(a.anchor), a.label) for anchor, a in self.base for at in self._places(anchor, line)]
        spans = []
        for anchor, automaton in self.templates:
            done = 0
            for at in self._places(anchor, line):
                # The earliest run that holds the anchor wins.
                for begin in range(max(done, at - automaton.before), at + 1):
                    end = automaton.match(tokens, begin)
                    if begin <= at and end >= at + len(automaton.anchor):
                        spans.append((begin, end, automaton.label))
                        done = end
                        break
        return len(tokens), base, spans


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Find license wording in every whole text, a row for each row of ``docs``.

    n_base counts every place of a base phrase, first_word and last_word are its smallest
    and largest start (null without one).  labels adds the templates' own; spans lists
    ``label:start:end`` in words.  score is the share of the words inside any span.  A
    null or empty text has no words, empty labels and score 0.  A very long text is read
    whole; of one template's runs over the same words the earliest and longest counts, and
    spans of several templates may overlap.  Repeated rows and null ids come back as they
    are, other columns are ignored, and an empty table gives no rows.
    """
    scanner = scanner or Scanner()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in strings(batch, "text"):
            n, base, spans = scanner.scan(text)
            starts = [s for s, _, _ in base]
            covered, reached = 0, 0
            for start, end, _ in sorted({*base, *spans}):
                covered += max(0, end - max(start, reached))
                reached = max(reached, end)
            rows.append((n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, _, x in base})), ",".join(sorted({x for _, _, x in [*base, *spans]})), covered / n if n else 0.0, ",".join(f"{x}:{s}:{e}" for s, e, x in sorted({*base, *spans}))))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [c.split()[0] for c in SCHEMA.split(", ")])

    return map_batches(text_rows(docs), run, SCHEMA)
