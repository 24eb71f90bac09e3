"""License scans: a trained paragraph classifier with a calibrated unknown class, confirmed against templates.

A paragraph (a line of text) is read in windows of SPAN words that overlap by half, and so are the joined lines between two blank ones, since
notices are wrapped; what only the joined lines show counts at the line where the notice begins. A window's sparse word n-grams (one to three words, those that
the templates hold, weighted to unit length) go through a multinomial logistic regression over the licence families and `unknown`. It is trained
here from the templates: each is cut, thinned, joined with other text and given names and years; unknown windows are shuffled template
words, legal talk that grants nothing, and words of no language. A temperature calibrates the probabilities: it is fitted for a model that has seen whole templates
only, on thinned ones, all of which are held back from it, and on unknown windows held back. A window is
predicted where a family's probability reaches THRESHOLD; the prediction is confirmed where the window holds at least CONFIRM of the word
pairs of one of the family's template sentences.

A window that shares no telling word pair with any template cannot be confirmed, so only windows with one are classified; that skips no result.

The model depends on no data, so every table is scanned by the same one. Defined cases: null and empty texts have no paragraphs and no
licence; repeated rows get the same result; texts of any length are scanned whole.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, read

SPAN, THRESHOLD, CONFIRM = 60, 0.6, 0.6
UNKNOWN = "unknown"

#: Sentences by which the families are declared, as their publishers recommend them.
TEMPLATES = {
    "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "licensed under the GNU Affero General Public License version 3", "released under the AGPL v3"],
    "all-rights-reserved": ["All rights reserved", "Copyright, all rights reserved, no part of this publication may be reproduced without prior written permission", "Unauthorized copying of this file is strictly prohibited"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", "released under the Apache 2.0 license"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "released under the BSD license", "licensed under the 3-clause BSD license"],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-nc-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "cc-by-sa-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "cc0-1.0": ["the person who associated a work with this deed has dedicated the work to the public domain by waiving all rights", "Licensed under CC0 1.0 Universal", "released into the public domain"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License", "licensed under the Eclipse Public License"],
    "gpl-2.0": ["under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "This work is licensed under the GNU General Public License, version 2", "released under the GPL v2"],
    "gpl-3.0": ["under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "This work is licensed under the GNU General Public License, version 3", "released under the GPL v3"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "released under the ISC license"],
    "lgpl": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "licensed under the GNU Lesser General Public License", "released under the LGPL"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "Released under the MIT License", "Licensed under the MIT license"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
}
#: The families' short identifiers, which stand in a line of their own behind this mark. Some licences without a family of their own have one too.
SHORT = {
    "agpl-3.0": ["AGPL-3.0"], "apache-2.0": ["Apache-2.0"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "cc-by-4.0": ["CC-BY-4.0"], "cc-by-nc-4.0": ["CC-BY-NC-4.0"], "cc-by-sa-4.0": ["CC-BY-SA-4.0"], "cc0-1.0": ["CC0-1.0"], "epl": ["EPL-1.0", "EPL-2.0"],
    "gpl-2.0": ["GPL-2.0"], "gpl-3.0": ["GPL-3.0"], "isc": ["ISC"], "lgpl": ["LGPL-2.1", "LGPL-3.0"], "mit": ["MIT"], "mpl-2.0": ["MPL-2.0"], "unlicense": ["Unlicense"],
}
OTHER_SHORT = ["Zlib", "Artistic-2.0", "PostgreSQL", "OFL-1.1", "NCSA", "Python-2.0", "BSL-1.0", "0BSD", "LicenseRef-Own"]
MARK = "SPDX-License-Identifier: "
TEMPLATES = {f: [*t, *(MARK + x for x in SHORT.get(f, ()))] for f, t in TEMPLATES.items()}
#: Legal or everyday talk that declares no licence, or none of the families.
DISTRACTORS = [
    "drivers must carry a valid license and show it to the police",
    "the committee reserved the right to change the terms of the agreement at any time",
    "the rights of the workers were discussed in public for the first time",
    "a general license to trade was granted by the king under the seal",
    "the software was released under great pressure and the version was full of errors",
    "the public library is free and open to any person with or without a card",
    "the apache helicopter was flown under the command of the general",
    "you may obtain a copy of the report at the front desk free of charge",
    "the work is subject to the conditions of the market and to applicable law",
    "she teaches at mit and the department published the source of the code",
    "creative work is common among people who use computers for any purpose",
    "the foundation published the first version of the document",
    *(MARK + x for x in OTHER_SHORT),
]
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)?")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:])), *(f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:]))}


def pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


@dataclass
class Model:
    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray  # features and a constant, by family; unknown last
    temperature: float
    sentences: list[tuple[int, set]]  # family, word pairs
    telling: set

    def classify(self, windows: list[list[str]]) -> np.ndarray:
        """Probabilities, one row a window, unknown last."""
        return _softmax(_products(_sparse(windows, self.vocabulary), self.weights) / self.temperature)

    def confirmed(self, family: int, words: list[str]) -> float:
        p = pairs(words)
        return max(len(p & s) / len(s) for f, s in self.sentences if f == family)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str, float]]]:
        """Number of paragraphs, and (paragraph, family, probability) of those that declare a licence; the most probable window of each family."""
        n, found, block = 0, [], []
        for line in [*(text or "").split("\n"), ""]:
            if line and not line.isspace():
                words = tokens(line)
                best = {f: p for f, p, _ in self._windows(words)}
                found += [(n, f, p) for f, p in sorted(best.items())]
                block.append((n, words, best))
                n += 1
            elif block:
                found += self._wrapped(block)
                block = []
        return n, sorted(found, key=lambda x: x[:2])

    def _windows(self, words: list[str], every: bool = False) -> list[tuple[str, float, int]]:
        """(family, probability, first word of the window): the most probable window of each family, or every one."""
        if self.telling.isdisjoint(zip(words, words[1:])):
            return []
        starts = range(0, max(1, len(words) - SPAN // 2), SPAN // 2)
        windows = [(i, words[i : i + SPAN]) for i in starts]
        windows = [(i, w) for i, w in windows if not self.telling.isdisjoint(zip(w, w[1:]))]
        if not windows:
            return []
        hits = []
        for (i, w), p in zip(windows, self.classify([w for _, w in windows]), strict=True):
            hits += [(self.families[k], float(p[k]), i) for k in np.flatnonzero(p[:-1] >= THRESHOLD) if self.confirmed(int(k), w) >= CONFIRM]
        return hits if every else sorted(hits, key=lambda x: x[1])

    def _wrapped(self, block: list[tuple[int, list[str], dict[str, float]]]) -> list[tuple[int, str, float]]:
        """Hits of the joined lines of a block that no line of the window has by itself; a hit counts at the first line that holds a pair of its sentence."""
        if len(block) < 2:
            return []
        line = [k for k, (_, words, _) in enumerate(block) for _ in words]
        words = [w for _, x, _ in block for w in x]
        have = {(k, f) for k, (_, _, best) in enumerate(block) for f in best}
        out: dict[tuple[int, str], float] = {}
        last: dict[str, tuple[int, int]] = {}  # window and paragraph of a family's last hit: windows that overlap read one notice
        for f, p, i in self._windows(words, every=True):
            if f in last and i - last[f][0] <= SPAN // 2:
                last[f] = (i, last[f][1])
                out[last[f][1], f] = max(p, out[last[f][1], f])
                continue
            w = words[i : i + SPAN]
            mine = pairs(w)
            sentence = max((s for g, s in self.sentences if self.families[g] == f), key=lambda s: len(mine & s) / len(s))
            at = [i + j for j, x in enumerate(zip(w, w[1:])) if x in sentence]
            span = range(line[at[0]], line[at[-1] + 1] + 1)
            if any((k, f) in have for k in span):
                continue
            # the window may end inside the sentence, where families begin alike: read again from the sentence's first word
            again = {g: x for g, x, at_word in self._windows(words[at[0] : at[0] + SPAN], every=True) if at_word == 0}
            if f not in again:
                continue
            last[f] = (i, block[span[0]][0])
            out[last[f][1], f] = max(p, again[f])
        return [(k, f, p) for (k, f), p in out.items()]


def _sparse(windows: list[list[str]], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, features, values) of the windows' n-grams, row by row. The last feature of each row is the constant, so no row is empty."""
    rows = [[vocabulary[g] for g in grams(w) if g in vocabulary] for w in windows]
    sizes = np.array([len(r) + 1 for r in rows])
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    features = np.array([f for r in rows for f in (*r, len(vocabulary))], np.int64)
    values = np.repeat([1 / max(1.0, np.sqrt(len(r)) / 4) for r in rows], sizes)
    values[first + sizes - 1] = 1
    return first, features, values


def _products(x: tuple[np.ndarray, np.ndarray, np.ndarray], weights: np.ndarray) -> np.ndarray:
    first, features, values = x
    return np.add.reduceat(weights[features] * values[:, None], first, axis=0)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _fit(x: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, shape: tuple[int, int], steps: int, rate: float, decay: float) -> np.ndarray:
    """Gradient descent on the softmax loss over sparse rows."""
    first, features, values = x
    row = np.repeat(np.arange(len(y)), np.diff(np.append(first, len(features))))
    by_feature = np.argsort(features, kind="stable")
    present, starts = np.unique(features[by_feature], return_index=True)
    row, scaled = row[by_feature], values[by_feature][:, None] / len(y)
    w, hot = np.zeros(shape), np.eye(shape[1])[y]
    for _ in range(steps):
        off = _softmax(_products(x, w)) - hot
        back = decay * w
        back[present] += np.add.reduceat(off[row] * scaled, starts, axis=0)
        w -= rate * back
    return w


def _examples(rng: random.Random) -> tuple[list[list[str]], list[int], list[bool]]:
    """(windows, families, whether they are held back for the temperature): all templates that lack words, and a fifth of the unknown."""
    families = sorted(TEMPLATES)
    every = [w for s in TEMPLATES.values() for t in s for w in tokens(t)]
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it is ar te se hi ng".split()
    noise = lambda n: ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]
    x, y, held = [], [], []
    for k, f in enumerate(families):
        for t in TEMPLATES[f]:
            words = tokens(t)
            for _ in range(30):
                thinned = rng.random() < 0.4
                w = [v for v in words if not thinned or rng.random() > 0.08] or words
                if rng.random() < 0.3:
                    w = ["copyright", "c", str(rng.randint(1990, 2025)), *noise(2), *w]
                x.append([*noise(rng.choice((0, 0, 0, 5, 20))), *w, *noise(rng.choice((0, 0, 0, 5, 20)))])
                y.append(k)
                held.append(thinned)
    for i in range(500):
        x.append(rng.choices(every, k=rng.randint(2, 25)) + noise(rng.randint(0, 10)))
        x.append(tokens(rng.choice(DISTRACTORS)) + noise(rng.choice((0, 8))))
        x.append(noise(rng.randint(2, 40)) + rng.choices(every, k=rng.randint(0, 4)))
        y += [len(families)] * 3
        held += [i % 5 == 0] * 3
    return x, y, held


@lru_cache(1)
def train(seed: int = 7, steps: int = 150, rate: float = 8.0, decay: float = 1e-4) -> Model:
    rng = random.Random(seed)
    families = sorted(TEMPLATES)
    vocabulary = {g: i for i, g in enumerate(sorted(set().union(*(grams(tokens(t)) for s in TEMPLATES.values() for t in s))))}
    x, y, held = _examples(rng)
    y, held, shape = np.array(y), np.array(held), (len(vocabulary) + 1, len(families) + 1)
    some = lambda keep: _sparse([w for w, k in zip(x, keep, strict=True) if k], vocabulary)
    z = _products(some(held), _fit(some(~held), y[~held], shape, steps, rate, decay))

    def loss(t: float) -> float:
        return float(-np.mean(np.log(_softmax(z / t)[np.arange(len(z)), y[held]] + 1e-12)))

    temperature = min((0.1 * k for k in range(1, 31)), key=loss)
    w = _fit(some(np.ones(len(y), bool)), y, shape, steps, rate, decay)
    sentences = [(k, pairs(tokens(t))) for k, f in enumerate(families) for t in TEMPLATES[f]]
    return Model(families, vocabulary, w, temperature, sentences, set().union(*(s for _, s in sentences)))


FOUND = "array<struct<paragraph: int, family: string, probability: double>>"
ADDED = ("n_paragraphs", "licenses")


def scan_licenses(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """docs with n_paragraphs and licenses (paragraph number, family, probability). Columns of these names are replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    k = docs.columns.index(text_col)
    held = Shared(docs.sparkSession, model or train())  # as large as the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        of = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64())]))
        for b in batches:
            rows = [m.scan(t) for t in b.column(k).to_pylist()]
            found = [[{"paragraph": i, "family": f, "probability": p} for i, f, p in r] for _, r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([n for n, _ in rows], pa.int64()), pa.array(found, of)], names=[*b.schema.names, *ADDED])

    added = T._parse_datatype_string(f"n_paragraphs long, licenses {FOUND}")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def op9_license_scans(spark, sf_dir):
    out = scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    families = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"])))
    best = F.coalesce(F.array_max(F.transform("licenses", lambda x: x["probability"])), F.lit(0.0))
    return out.select("doc_id", "n_paragraphs", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(families, ",").alias("families"), best.alias("probability"))
