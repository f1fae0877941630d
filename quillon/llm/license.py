"""Licence scans by a trained paragraph classifier.

A paragraph is a run of lines between blank ones; lines that hold only marks, as in comments, are blank.  Its words are runs of ASCII letters,
digits and bytes beyond ASCII, A-Z lower-cased, so comment marks and line ends inside a notice play no part.  A softmax regression
on sparse word n-grams (one to three words, those of the templates) tells licence families and an unknown
class.  It is trained on the templates, on copies of them with words dropped, cut and surrounded by words of the corpus, on
jumbled words of licences as unknown, and on lines of a sample of documents that no template confirms, as
unknown too.  The sample is bounded: `SAMPLE` documents (those whose hashed doc_id is least, one text of each), cut into stretches of
`STRETCH` words, of which the `MOST_LINES` of least hash are used.  A temperature and an offset of the unknown class are calibrated on rows left out of training.

Templates of every family whose calibrated probability is `LEAST_PROBABILITY` or more are compared with the paragraph.  A family
stands if a template of it confirms it: nearly all of the template's n-grams are in the
paragraph, or the paragraph consists of the template's for the most part.  Titles confirm in the second way only.  A family all of whose n-grams there belong to the template of
one that fits better does not stand.  After
that the lines of a paragraph are looked at by themselves for families that it does not have as a whole.  Paragraphs and lines of all lengths are scanned.

Null and empty texts have no licences, and empty tables no rows.  Repeated rows are scanned one for one; with no
documents to sample the unknown class is learnt from the templates' shuffled words.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import textkit as tk
from quillon.llm.decontaminate import normalised
from quillon.llm.quality import minimised

SAMPLE = 1500
COPIES = 30
STRETCH = 200
MOST_LINES = 12_000
#: Share of a template that a paragraph must hold, and share of a paragraph that must come from a template.
OF_TEMPLATE, OF_PARAGRAPH = 0.8, 0.7
LEAST_PROBABILITY = 0.05
FLAG_BITS = 20
UNKNOWN = "unknown"

#: Notices of public licences, a paragraph each, and their identifiers.
TEMPLATES = {
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "reserved": ["All rights reserved.", "Copyright holders reserve all rights; no part may be reproduced without prior written permission."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
}

#: Titles, which name a licence where a paragraph or line is little else.
TITLES = {
    "agpl": ["GNU Affero General Public License Version 3"],
    "apache": ["Apache License Version 2.0", "Apache License 2.0"],
    "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License"],
    "gpl": ["GNU General Public License Version 2", "GNU General Public License Version 3"],
    "isc": ["ISC License"],
    "lgpl": ["GNU Lesser General Public License Version 3"],
    "mit": ["MIT License", "The MIT License (MIT)"],
    "mpl": ["Mozilla Public License Version 2.0"],
    "unlicense": ["The Unlicense"],
}

_A, _B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


@dataclass
class Lines:
    """Words of a block's lines, and its paragraphs."""

    words: np.ndarray  # hashes of the words of all lines
    at: np.ndarray  # where each line's words begin (n + 1 values)
    of_docs: np.ndarray  # where each document's lines begin (n + 1 values)
    first: np.ndarray  # the first line of each paragraph
    end: np.ndarray  # and the line behind its last

    @staticmethod
    def of(buf: np.ndarray, off: np.ndarray) -> Lines:
        breaks = np.flatnonzero(buf == 10) + 1
        edges = np.union1d(np.union1d(off, breaks), [0])
        data, bounds = normalised(buf, edges)
        h, at = tk.words(data, bounds)
        of_docs = np.searchsorted(edges, off)
        solid = np.diff(at) > 0
        before = np.concatenate([[False], solid[:-1]])
        before[of_docs[of_docs < len(solid)]] = False
        after = np.concatenate([solid[1:], [False]])
        after[of_docs[(of_docs > 0) & (of_docs <= len(solid))] - 1] = False
        return Lines(h, at, of_docs, np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1)


def ngrams(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of one to three words within a line, and the line of each."""
    line = tk.owners(at)
    two = line[:-1] == line[1:]
    pairs = tk.mix(h[:-1][two] * _A + h[1:][two])
    three = line[:-2] == line[2:]
    triples = tk.mix((h[:-2][three] * _A + h[1:-1][three]) * _B + h[2:][three])
    return np.concatenate([h, pairs, triples]), np.concatenate([line, line[:-1][two], line[:-2][three]])


def gram_sets(texts: list[str]) -> list[np.ndarray]:
    """Distinct n-gram hashes of single-line texts."""
    buf, off = tk.column_bytes(pa.array([t.replace("\n", " ") for t in texts], pa.string()))
    data, at = normalised(buf, off)
    g, line = ngrams(*tk.words(data, at))
    return [np.unique(g[line == k]) for k in range(len(texts))] if len(texts) < 500 else _split(g, line, len(texts))


def _split(g: np.ndarray, line: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(line, kind="stable")
    return [np.unique(x) for x in np.split(g[order], np.searchsorted(line[order], np.arange(1, n)))]


@dataclass
class Model:
    families: list[str]  # and unknown, the last class
    table: tk.HashTable
    flags: np.ndarray
    weights: np.ndarray  # n-grams x classes, rows of the table's keys; scaled by the temperature
    bias: np.ndarray
    templates: list[tuple[int, np.ndarray, bool]]  # family, distinct n-grams, whether it is a title

    def features(self, g: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (line, feature) pairs, by line."""
        near = np.flatnonzero(self.flags[(g >> np.uint64(64 - FLAG_BITS)).astype(np.int64)])
        f = self.table.find(g[near]).astype(np.int64)
        near, f = near[f >= 0], f[f >= 0]
        pairs = np.unique(line[near] * len(self.weights) + f)
        return pairs // len(self.weights), pairs % len(self.weights)

    def probabilities(self, line: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lines with a feature, class probabilities of each). All other lines have the biases alone."""
        lines, first = np.unique(line, return_index=True)
        if not len(lines):
            return lines, np.zeros((0, len(self.bias)))
        z = np.add.reduceat(self.weights[f], first, axis=0) + self.bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return lines, p / p.sum(axis=1, keepdims=True)

    def similarity(self, family: int, grams: np.ndarray) -> tuple[bool, float, np.ndarray]:
        """Whether a template of the family confirms distinct n-grams of a paragraph, the best share in common and the n-grams of the first such template."""
        best, ok = 0.0, np.zeros(0, np.uint64)
        for k, t, title in self.templates:
            if k == family and len(t):
                both = len(np.intersect1d(t, grams, assume_unique=True))
                of_t, of_p = both / len(t), both / max(1, len(grams))
                best = max(best, of_p, 0.0 if title else of_t)
                if not len(ok) and (of_p >= OF_PARAGRAPH or not title and of_t >= OF_TEMPLATE):
                    ok = t
        return len(ok) > 0, best, ok

    def compared(self, grams: np.ndarray, told: list[tuple[int, float, bool]]) -> list[tuple[int, float, bool, float, np.ndarray]]:
        """(family, probability, confirmed, similarity, template) of families (family, probability, whether likeliest) that are confirmed or likeliest."""
        found = [(k, p, best, *self.similarity(k, grams)) for k, p, best in told]
        out, covered, most = [], np.zeros(0, np.uint64), 0.0
        for k, p, best, ok, share, t in sorted(found, key=lambda x: (-x[4], -x[1])):
            if ok and (share >= most or len(np.setdiff1d(np.intersect1d(t, grams), covered))):
                out.append((k, p, True, share, t))
                covered, most = np.union1d(covered, t), max(most, share)
            elif best:
                out.append((k, p, False, share, t))
        return out

    def confirmed_rows(self, sets: list[np.ndarray]) -> np.ndarray:
        """Of many sets of n-grams, which ones any template confirms."""
        size = np.array([len(x) for x in sets])
        row, f = self.features(np.concatenate(sets), np.repeat(np.arange(len(sets)), size)) if len(sets) else (np.zeros(0, np.int64),) * 2
        out = np.zeros(len(sets), bool)
        for _, t, title in self.templates:
            own = np.zeros(len(self.weights), bool)
            own[self.table.find(t)] = True
            both = np.bincount(row[own[f]], minlength=len(sets))
            out |= both >= OF_PARAGRAPH * np.maximum(size, 1)
            if not title:
                out |= both >= OF_TEMPLATE * len(t)
        return out


class Softmax:
    """Mean log-loss of a softmax regression with a ridge over sparse binary rows."""

    def __init__(self, row: np.ndarray, f: np.ndarray, y: np.ndarray, width: int, classes: int, ridge: float):
        self.row, self.f, self.y, self.shape, self.ridge = row, f, y, (width + 1, classes), ridge
        self.rows, self.row_at = np.unique(row, return_index=True)  # rows ascend
        self.order = np.argsort(f, kind="stable")
        self.used, self.used_at = np.unique(f[self.order], return_index=True)

    def logits(self, w: np.ndarray) -> np.ndarray:
        z = np.zeros((len(self.y), self.shape[1]))
        if len(self.f):
            z[self.rows] = np.add.reduceat(w[self.f], self.row_at, axis=0)
        return z + w[-1]

    def __call__(self, p: np.ndarray) -> tuple[float, np.ndarray]:
        w = p.reshape(self.shape)
        z = self.logits(w)
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        q = e / e.sum(axis=1, keepdims=True)
        n = len(self.y)
        loss = -np.log(np.maximum(q[np.arange(n), self.y], 1e-300)).mean()
        q[np.arange(n), self.y] -= 1
        g = np.zeros(self.shape)
        if len(self.f):
            g[self.used] = np.add.reduceat(q[self.row[self.order]], self.used_at, axis=0) / n
        g[-1] = q.sum(axis=0) / n
        g[:-1] += self.ridge * w[:-1]
        return float(loss + 0.5 * self.ridge * (w[:-1] ** 2).sum()), g.ravel()


def train(background: list[str], seed: int = 11) -> Model:
    """background: whole texts of the corpus."""
    rng = np.random.Generator(np.random.PCG64(seed))
    families = sorted(TEMPLATES)
    known = [(k, t) for k, name in enumerate(families) for t in TEMPLATES[name] + TITLES.get(name, [])]
    titles = [t in TITLES.get(families[k], []) for k, t in known]
    sets = gram_sets([t for _, t in known])
    keys = np.unique(np.concatenate(sets))
    flags = np.zeros(1 << FLAG_BITS, bool)
    flags[(keys >> np.uint64(64 - FLAG_BITS)).astype(np.int64)] = True
    unknown = len(families)
    model = Model(families, tk.HashTable(keys), flags, np.zeros((len(keys), unknown + 1), np.float32), np.zeros(unknown + 1), [(k, s, title) for (k, _), s, title in zip(known, sets, titles, strict=True)])

    lines = sorted({x for t in background for x in t.split("\n") if x.strip()})
    if len(lines) > MOST_LINES:
        lines = [lines[i] for i in np.sort(rng.choice(len(lines), MOST_LINES, replace=False))]
    words = np.array([w for x in lines for w in x.split()] or [w for _, t in known for w in t.split()])
    clean = [x for x, known_ in zip(lines, model.confirmed_rows(gram_sets(lines)), strict=True) if not known_] if lines else []
    if not clean:
        clean = [" ".join(rng.permutation(words)[: rng.integers(3, 30)]) for _ in range(500)]
    # Words that licences use, out of order, are unknown too.
    jumbled = [" ".join(rng.permutation([w for j in rng.integers(0, len(known), 3) for w in known[j][1].split()])[: rng.integers(1, 20)]) for _ in range(600)]

    texts, y = [], []
    for k, t in known:
        own = t.split()
        for c in range(COPIES):
            some = own
            if c and len(own) > 6:
                some = [w for w in own if rng.random() > 0.05]
                if c % 3 == 0:
                    a = int(rng.integers(0, len(some) // 3))
                    some = some[a : a + max(5, 2 * len(some) // 3)]
            around = [" ".join(rng.choice(words, int(rng.integers(0, 12)))) if c % 2 else "" for _ in range(2)]
            texts.append(" ".join([around[0], *some, around[1]]))
            y.append(k)
    texts += clean + jumbled
    label = np.array(y + [unknown] * (len(clean) + len(jumbled)))
    buf, off = tk.column_bytes(pa.array([t.replace("\n", " ") for t in texts], pa.string()))
    data, at = normalised(buf, off)
    row, f = model.features(*ngrams(*tk.words(data, at)))
    out = rng.random(len(label)) < 0.2
    fit = Softmax(*_rows(row, f, ~out), label[~out], len(keys), unknown + 1, 1e-5)
    w = minimised(fit, np.zeros((len(keys) + 1) * (unknown + 1)), steps=80).reshape(fit.shape)
    test = Softmax(*_rows(row, f, out), label[out], len(keys), unknown + 1, 0.0)
    z = test.logits(w)
    best = (np.inf, 1.0, 0.0)
    for t in (0.5, 0.7, 1.0, 1.4, 2.0):  # temperature and the unknown class's offset, by the log-loss of rows left out
        for b in np.linspace(-3, 3, 25):
            q = z / t
            q[:, unknown] += b
            m = q.max(axis=1)
            loss = float((m + np.log(np.exp(q - m[:, None]).sum(axis=1)) - q[np.arange(len(q)), test.y]).mean())
            best = min(best, (loss, t, float(b)))
    model.weights, model.bias = (w[:-1] / best[1]).astype(np.float32), w[-1] / best[1]
    model.bias[unknown] += best[2]
    return model


def _rows(row: np.ndarray, f: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.cumsum(use) - 1
    keep = use[row]
    return place[row[keep]], f[keep]


def candidates(model: Model, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, list[tuple[int, float, bool]]]]:
    """(unit, its families: family, probability, whether it is the likeliest class) of units of words, in order."""
    units, p = model.probabilities(*model.features(*ngrams(words, at)))
    if len(units):
        best = p.argmax(axis=1)
        enough = p[:, :-1] >= LEAST_PROBABILITY
        for u in np.flatnonzero(enough.any(axis=1)).tolist():
            yield int(units[u]), [(k, float(p[u, k]), k == best[u]) for k in np.flatnonzero(enough[u]).tolist()]


def found_in_block(model: Model, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, float, bool, float]]:
    """(document, line on which it begins, class, probability, confirmed, similarity) of families that are confirmed or told to be likeliest."""
    lines = Lines.of(buf, off)
    own_grams = lambda a, b: np.unique(ngrams(lines.words[a:b], np.array([0, b - a]))[0])
    found: dict[tuple[int, int], tuple[float, bool, float]] = {}  # by line and class
    taken: dict[int, set[int]] = {}  # families of a paragraph, by its first line
    long = np.flatnonzero(lines.end - lines.first > 1)
    if len(long):
        a, b = lines.at[lines.first[long]], lines.at[lines.end[long]]
        pick = np.concatenate([np.arange(x, y) for x, y in zip(a, b, strict=True)])
        for u, told in candidates(model, lines.words[pick], np.concatenate([[0], np.cumsum(b - a)])):
            first, end = int(lines.first[long[u]]), int(lines.end[long[u]])
            for k, p, ok, share, template in model.compared(own_grams(int(a[u]), int(b[u])), told):
                if ok:
                    taken.setdefault(first, set()).add(k)
                found[begins(lines, first, end, template) if ok else first, k] = p, ok, share
    for n, told in candidates(model, lines.words, lines.at):
        paragraph = int(lines.first[int(np.searchsorted(lines.first, n, "right")) - 1])
        for k, p, ok, share, _ in model.compared(own_grams(int(lines.at[n]), int(lines.at[n + 1])), told):
            if k not in taken.get(paragraph, ()) and (ok or (n, k) not in found):
                found[n, k] = p, ok, share
    out = []
    for (n, k), (p, ok, share) in found.items():
        doc = int(np.searchsorted(lines.of_docs, n, "right")) - 1
        out.append((doc, n - int(lines.of_docs[doc]), k, p, ok, share))
    return sorted(out)


def begins(lines: Lines, first: int, end: int, template: np.ndarray) -> int:
    """The first line of a paragraph on which two or three words stand together as in the template; else its first line."""
    a, b = int(lines.at[first]), int(lines.at[end])
    h = lines.words[a:b]
    pairs = tk.mix(h[:-1] * _A + h[1:])
    hits = np.flatnonzero(np.isin(tk.mix((h[:-2] * _A + h[1:-1]) * _B + h[2:]), template)) if len(h) > 2 else np.zeros(0, np.int64)
    if not len(hits):
        hits = np.flatnonzero(np.isin(pairs, template))
    return first if not len(hits) else int(np.searchsorted(lines.at, a + hits[0], "right")) - 1


FOUND = "array<struct<paragraph: int, family: string, probability: double, confirmed: boolean, similarity: double>>"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            out = set()
            for line in (text.as_py() or "").split("\n"):
                w = line.split()
                out.update(" ".join(w[k : k + STRETCH]) for k in range(0, len(w), STRETCH))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.string())], names=["line"])


def background(rows: DataFrame, sample: int) -> list[str]:
    """At most MOST_LINES stretches of lines of `sample` documents. rows: doc_id and text."""
    ids = rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = rows.where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    lines = chosen.select("text").mapInArrow(_stretches, "line string").distinct()
    return sorted(r["line"] for r in lines.orderBy(F.xxhash64("line"), "line").limit(MOST_LINES).collect())


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and licences of every row: paragraph (the line, from 0, on which the notice begins), family, probability, whether a template confirms it, similarity."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(train(background(rows, sample)))  # bounded by the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_()), ("similarity", pa.float64())]))
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for lo, _, buf, off in tk.blocks(batch.column(1)):
                for d, n, k, p, ok, s in found_in_block(model, buf, off):
                    out[lo + d].append({"paragraph": n, "family": model.families[k], "probability": p, "confirmed": ok, "similarity": s})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "licences"])

    return rows.mapInArrow(run, f"doc_id long, licences {FOUND}")
