"""License scans: an exact set-similarity join of text blocks with templates.

Blocks are all windows of neighbouring words, a quarter longer than the
template, so that a licence is found however its lines are broken. Template
tokens are ordered by how many documents of the corpus hold them, rarest
first. A block that meets the containment threshold of a template must hold
one of the template's first n - ceil(t n) + 1 tokens (prefix filter): only
words around such a token are looked at. They must hold ceil(t n) words
(length filter), and the first shared token must leave enough of both behind
it (positional filter). What is left is counted exactly, window by window.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragworks.llm.words import words

#: Phrases and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label and text of each template; a table of one's own is a parameter of license_scan.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,"
        " either version 3 of the License, or (at your option) any later version.",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source"
        " code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright"
        " notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies.",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
]
CONTAINMENT = 0.9


def window(n_words: int) -> int:
    """Words of a block that is held against a template of so many."""
    return n_words + n_words // 4


def needed(n: int, containment: float) -> int:
    return max(1, math.ceil(containment * n - 1e-9))


def token_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """Documents of the corpus that hold each template token; as many rows as the templates have tokens."""
    vocabulary = frozenset(w for _, t in templates for w in words(t))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(vocabulary.intersection(words(text)))
        yield pd.DataFrame({"token": list(seen), "n": list(seen.values())}).astype({"n": "int64"})

    rows = docs.select("text").mapInPandas(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(vocabulary, 0) | {bytes(r["token"]): r["n"] for r in rows}


class Scanner:
    def __init__(self, frequency: dict[bytes, int], templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT):
        order = {w: i for i, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
        self.order = order
        self.templates = []
        self.prefix: dict[bytes, list[int]] = {}
        for label, text in templates:
            tokens = sorted(set(words(text)), key=order.__getitem__)
            must = needed(len(tokens), containment)
            for w in tokens[: len(tokens) - must + 1]:
                self.prefix.setdefault(w, []).append(len(self.templates))
            place = np.full(len(order) + 1, -1)  # the last is for words of no template
            place[[order[w] for w in tokens]] = np.arange(len(tokens))
            self.templates.append((label, place, len(tokens), must, window(len(words(text)))))
        self.phrases = [(b" " + b" ".join(words(p)) + b" ", label) for p, label in phrases.items()]

    def best(self, template: int, known: np.ndarray, at: np.ndarray) -> int:
        """The most different tokens of a template in one window; 0 if no window has enough. known: words of templates and where they stand."""
        _, place, n, must, width = self.templates[template]
        own = place[known]
        at, own = at[own >= 0], own[own >= 0]
        rare = at[own <= n - must]
        most = 0
        # neighbourhoods of the rare tokens, joined where their windows meet
        cuts = np.flatnonzero(np.diff(rare) >= 2 * width) + 1
        for near in np.split(rare, cuts):
            lo, hi = np.searchsorted(at, near[0] - width + 1), np.searchsorted(at, near[-1] + width)
            held = np.unique(own[lo:hi])
            if near[-1] - near[0] + 2 * width - 1 >= must and 1 + min(n - 1 - held[0], len(held) - 1) >= must:
                most = max(most, _densest(at[lo:hi].tolist(), own[lo:hi].tolist(), n, width))
        return most if most >= must else 0

    def scan(self, text: str | None) -> tuple:
        ws = words(text)
        spaced = b" " + b" ".join(ws) + b" "
        places, base, starts = [], set(), None
        for phrase, label in self.phrases:
            at, found = spaced.find(phrase), []
            while at >= 0:
                found.append(at)
                at = spaced.find(phrase, at + 1)
            if found:
                if starts is None:
                    starts = np.cumsum([0, *(len(w) + 1 for w in ws)])
                places += np.searchsorted(starts, found).tolist()
                base.add(label)
        score = 1.0 if places else 0.0
        labels = set(base)
        rare = self.prefix.keys() & ws
        if rare:
            known = np.fromiter((self.order.get(w, -1) for w in ws), np.int64, len(ws))
            at = np.flatnonzero(known >= 0)
            for t in sorted({t for w in rare for t in self.prefix[w]}):
                most = self.best(t, known[at], at)
                if most:
                    labels.add(self.templates[t][0])
                    score = max(score, most / self.templates[t][2])
        first, last = (min(places), max(places)) if places else (None, None)
        return len(ws), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def _densest(at: list[int], own: list[int], n: int, width: int) -> int:
    """The most different tokens within any `width` places; at: places in order, own: the token of each."""
    times, different, most, first = [0] * n, 0, 0, 0
    for place, token in zip(at, own):
        different += not times[token]
        times[token] += 1
        while at[first] <= place - width:
            times[own[first]] -= 1
            different -= not times[own[first]]
            first += 1
        most = max(most, different)
    return most


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """Licences of every row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels come from phrases whose words stand consecutively anywhere
    in the text; labels add those of the templates that some window of words
    contains, whatever the line breaks.
    score is the best containment, 1 with a phrase, 0 with nothing. A null
    text counts as empty: 0 words, empty label lists, null places. Repeated
    rows give repeated rows; an empty table an empty result; columns besides
    doc_id and text are not read.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(token_frequencies(docs, templates), templates, phrases, containment))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    def licenses(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = pd.DataFrame([scanner.value.scan(t) for t in batch], columns=names)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", licenses(F.col("text")).alias("__got")).select("doc_id", *[F.col(f"__got.{c}") for c in names])
