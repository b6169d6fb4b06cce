"""License scans: template markup compiled to token automata.

A template is license wording with two kinds of markup::

    <<opt>> ... <<end>>      a region that may be left out
    <<any:N>>                a replaceable region: one to N words of any kind
    <<any?:N>>               the same, or nothing

Everything else is mandatory: its words (letters and digits, case and punctuation ignored) must stand in a
text consecutively and exactly. Each template becomes a nondeterministic automaton over word hashes; it runs
from every place of a text where its first two words stand, over the whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import pick
from gridloom.llm.words import ALNUM, hash_of, phrase_words, slices

#: Phrases that label a text by themselves.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public license wording with markup, as (label, template).
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of <<any:12>> to deal in the <<any:3>> without restriction"),
    ("mit", "Released under <<opt>>the<<end>> <<opt>>terms of the<<end>> MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 <<opt>>(the \"License\"); you may not use this file except in compliance with the License<<end>>"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, <<any:6>> distributed under the License is distributed on an \"AS IS\" BASIS"),
    ("gpl", "This program is free software <<any?:3>> you can redistribute it and/or modify it under the terms of the GNU <<opt>>Lesser<<end>> General Public License as published by the Free Software Foundation"),
    ("gpl-versioned", "is licensed under the GNU <<opt>>Affero<<end>> <<opt>>Lesser<<end>> General Public License <<opt>>as published by the Free Software Foundation<<end>> version <<any:1>>"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, <<opt>>v. 2.0<<end>>"),
    ("cc-by-nc", "Licensed under <<opt>>the<<end>> CC BY NC <<opt>>SA<<end>> <<any:2>>"),
    ("cc-by", "is licensed under a Creative Commons Attribution <<any?:2>> <<any:2>> International License"),
)

#: What a base phrase alone and what an accepted template contribute to the score.
PHRASE_SCORE, TEMPLATE_SCORE = 0.6, 0.95


@dataclass(frozen=True)
class Automaton:
    """States 0..n-1; state i steps to i+1 on word ``word[i]`` (None: any word); ``skip[i]``: states reached for nothing."""

    label: str
    word: tuple
    skip: tuple
    mandatory: int

    def closure(self, states: set) -> set:
        todo = list(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def accepted_end(self, hashes, at: int, stop: int) -> int:
        """The end of the longest accepted run of words that begins at ``at``; -1 if there is none."""
        last, states, found = len(self.word), self.closure({0}), -1
        while True:
            if last in states:
                found = at
            if at >= stop:
                return found
            h = hashes[at]
            states = self.closure({i + 1 for i in states if i < last and (self.word[i] is None or self.word[i] == h)})
            if not states:
                return found
            at += 1


def compile_template(label: str, markup: str) -> Automaton:
    words: list = []
    skips: dict[int, set] = {}
    opened: list[int] = []
    mandatory = 0
    for part in re.split(r"(<<[^>]*>>)", markup):
        if part == "<<opt>>":
            opened.append(len(words))
        elif part == "<<end>>":
            skips.setdefault(opened.pop(), set()).add(len(words))
        elif m := re.fullmatch(r"<<any(\??):(\d+)>>", part):
            begin, n = len(words), int(m[2])
            words += [None] * n
            for i in range(begin + (0 if m[1] else 1), begin + n):
                skips.setdefault(i, set()).add(begin + n)
        elif part.startswith("<<"):
            raise ValueError(f"unknown markup {part}")
        else:
            found = phrase_words(part)
            mandatory += len(found) * (not opened)
            words += found
    if opened:
        raise ValueError("an optional region is not closed")
    if len(words) < 2 or None in words[:2] or 0 in skips or 1 in skips:
        raise ValueError("a template must begin with two mandatory words")
    known = dict(zip(dict.fromkeys(w for w in words if w), hash_of(list(dict.fromkeys(w for w in words if w)))))
    return Automaton(label, tuple(None if w is None else int(known[w]) for w in words), tuple(tuple(sorted(skips.get(i, ()))) for i in range(len(words) + 1)), mandatory)


def _scan(phrases, automata):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("template_spans", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = part.words(ALNUM)
                h, pos = w.hash, w.position()
                n = part.rows
                n_base = np.zeros(n, np.int64)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base: dict[int, set] = {}
                for want, label in phrases:
                    at = w.run(len(want))
                    for k, x in enumerate(want):
                        at = at[h[at + k] == x]
                    doc = w.doc[at]
                    n_base += np.bincount(doc, minlength=n)
                    np.minimum.at(first, doc, pos[at])
                    np.maximum.at(last, doc, pos[at])
                    for d in np.unique(doc):
                        base.setdefault(int(d), set()).add(label)
                more: dict[int, set] = {}
                spans: dict[int, list] = {}
                pairs = w.run(2)
                for a in automata:
                    at = pairs[h[pairs] == np.uint64(a.word[0])]
                    at = at[h[at + 1] == np.uint64(a.word[1])]
                    for i in map(int, at):
                        d = int(w.doc[i])
                        end = a.accepted_end(h, i, int(w.first[d] + w.count[d]))
                        if end >= 0:
                            more.setdefault(d, set()).add(a.label)
                            spans.setdefault(d, []).append(f"{a.label}:{i - w.first[d]}:{end - w.first[d]}")
                score = np.zeros(n)
                score[list(base)] = PHRASE_SCORE
                score[list(more)] = TEMPLATE_SCORE
                score[[d for d in more if d in base]] = 1.0
                none = n_base == 0
                joined = lambda d, *sets: ",".join(sorted(set().union(*(s.get(d, ()) for s in sets))))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.batch.column(part.batch.schema.get_field_index("doc_id")),
                        pa.array(w.count.astype(np.int64)),
                        pa.array(n_base),
                        pa.array(first, mask=none),
                        pa.array(last, mask=none),
                        pa.array([joined(d, base) for d in range(n)], pa.string()),
                        pa.array([joined(d, base, more) for d in range(n)], pa.string()),
                        pa.array(score),
                        pa.array([sorted(spans.get(d, ())) for d in range(n)], pa.list_(pa.string())),
                    ],
                    schema=schema,
                )

    return run


def license_scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Scan whole texts of ``docs`` (doc_id, text) for license phrases and templates.

    Returns one row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word (places of the base
    phrases, words from 0, null if there is none), base_labels, labels (with the templates' labels), score
    (0 nothing, 0.6 a phrase, 0.95 a template, 1 both) and template_spans (label:first word:end word).

    A null text counts as empty: no words, empty labels, score 0. Repeated rows are scanned each on its own;
    a null doc_id stays null; overlapping places all count; an empty table gives an empty result; other
    columns of ``docs`` are ignored. One narrow pass: no shuffle, memory bounded by the longest text.
    """
    compiled = [([np.uint64(x) for x in hash_of(phrase_words(p))], label) for p, label in phrases]
    automata = [compile_template(*t) for t in templates]
    out = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, template_spans array<string>"
    return pick(docs, "doc_id", "text").mapInArrow(_scan(compiled, automata), out)
