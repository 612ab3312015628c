"""License scans: a trained paragraph classifier over sparse word n-grams.

A multinomial logistic regression over hashed word 1- and 2-grams is trained on variants of licence templates and, as
the unknown class, on corpus lines (at most ``negatives``).  A temperature fitted on templates that the model has not seen
calibrates it.  Every line of every document is classified, and every block of lines between blank ones, for notices
that are wrapped; a prediction counts if the unknown class is not the likeliest and a template of the family has its
word pairs in the text, or the text's in the template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import LOWER, mix, prefix_hash, span_hash

FEATURES = 1 << 16
#: Words of a window, and from one to the next.
WINDOW, STEP = 80, 40
RESULT = "doc_id long, family string, probability double, similarity double, paragraph long, n_paragraphs long, families array<string>"
_WORD = re.compile(r"[0-9a-z\x80-\xff]+")
_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

#: What licence notices say, by family.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is made available under the terms of the Apache License 2.0; see the LICENSE file for the full text of the Apache License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "This project is open source under the terms of the MIT license, see the LICENSE file.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License, version 3, along with this program.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0-only",
        "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "released under the terms of the GNU Affero General Public License, either version 3 of the License, or any later version",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original author and source are credited.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "You may share and adapt the material under the Creative Commons Attribution-NonCommercial License, but not for commercial purposes.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
    ],
    "CC0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
        "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication.",
        "No rights reserved: CC0 waives all copyright in this work worldwide.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright (c) 2020 Example Inc. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
        "This document contains confidential and proprietary information and may not be copied or disclosed without permission.",
        "Unauthorized copying, distribution or reproduction of this material is strictly prohibited.",
    ],
}
#: Words that may stand around a notice.
AROUND = "this text page article document content file software by the authors and contributors copyright c 2019 2021 2024 see terms for details on our site".split()
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *TEMPLATES]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower().encode().decode("latin-1"))


def pairs(text: str) -> set:
    w = words(text)
    return set(zip(w, w[1:])) or set(w)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of each range, one after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


_TEMPLATE_PAIRS = {f: [pairs(t) for t in ts] for f, ts in TEMPLATES.items()}


def similarity(family: str, text: str) -> float:
    """The largest share of a template's word pairs that the text has, or of the text's that the template has."""
    own = pairs(text)
    return max((max(len(own & t) / len(t), len(own & t) / len(own) if len(own) >= 4 else 0.0) for t in _TEMPLATE_PAIRS[family]), default=0.0) if own else 0.0


class Units:
    """What is classified: the lines of texts, and blocks of lines between blank ones, long ones in overlapping windows.

    start and end: word places of each unit; text: its text; line: the line of its first word there; block: whether it
    is of a block of several lines.  one and two: hashed words and word pairs by place.
    """

    def __init__(self, texts: list[bytes]):
        data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        edge = np.diff(_SOLID[data].view(np.int8), prepend=np.int8(0))
        self.first, self.last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        n = len(self.first)
        line = np.searchsorted(np.flatnonzero(data == 10), self.first)
        text_of = np.repeat(np.arange(len(texts)), [t.count(b"\n") + 1 for t in texts])
        text = text_of[line]
        one = span_hash(prefix_hash(data), self.first, self.last)
        self.one = (one >> np.uint64(48)).astype(np.int32)
        two = mix(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])
        self.two = (two >> np.uint64(48)).astype(np.int32)
        parted = (text[1:] != text[:-1]) | (line[1:] > line[:-1] + 1)
        starts, ends = self._windows(np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])[:n]), n)
        s, e = self._windows(np.flatnonzero(np.concatenate([[True], parted])[:n]), n)
        several = line[s] < line[e - 1] if n else np.zeros(0, bool)
        self.start, self.end = np.concatenate([starts, s[several]]), np.concatenate([ends, e[several]])
        self.block = np.arange(len(self.start)) >= len(starts)
        self.text = text[self.start] if n else np.zeros(0, np.int64)
        begin = np.searchsorted(text_of, np.arange(len(texts)))
        self.line = (line[self.start] if n else np.zeros(0, np.int64)) - begin[self.text]
        self.raw = b"\n".join([*texts, b""])

    @staticmethod
    def _windows(begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs of words that begin at these places, cut into windows of ``WINDOW`` words at every ``STEP``."""
        size = np.diff(np.append(begin, n))
        count = np.maximum(1, -(-(size - WINDOW) // STEP) + 1)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(begin, count) + nth * STEP
        return start, np.minimum(start + WINDOW, np.repeat(begin + size, count))

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all units, one unit after the other, and how many each has."""
        size = self.end - self.start
        unit = np.concatenate([np.repeat(np.arange(len(size)), size), np.repeat(np.arange(len(size)), size - 1)])
        both = np.concatenate([self.one[_ranges(self.start, size)], self.two[_ranges(self.start, size - 1)]])
        return both[np.argsort(unit, kind="stable")], 2 * size - 1

    def said(self, i: int) -> str:
        """The words of a unit, as they stand."""
        return self.raw[self.first[self.start[i]] : self.last[self.end[i] - 1]].decode(errors="replace")


class Model:
    """recall: of held-out templates' variants by family, the share whose family was the likeliest."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0, recall: dict[str, float] | None = None):
        self.weights, self.bias, self.temperature, self.recall = weights, bias, temperature, recall or {}

    def probabilities(self, feature: np.ndarray, count: np.ndarray) -> np.ndarray:
        """By unit and family; features of the units stand one after the other, at least one each."""
        z = np.tile(self.bias, (len(count), 1)).astype(np.float64)
        first = np.cumsum(count) - count
        for a in range(0, len(count), 20000):  # units at a time
            b = min(len(count), a + 20000)
            own = feature[first[a] : first[b - 1] + count[b - 1]]
            z[a:b] += np.add.reduceat(self.weights[own], first[a:b] - first[a]) / np.sqrt(count[a:b])[:, None]
        z /= self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _variants(rng: np.random.Generator, each: int, held: bool | None = None) -> tuple[list[str], list[int]]:
    """Notices with words before and after, some words lost or changed in case.

    held: only of each family's last template (True), of the others (False), or of all.
    """
    texts, kinds = [], []
    for f, templates in TEMPLATES.items():
        templates = templates if held is None else templates[-1:] if held else templates[:-1]
        for n in range(each):
            w = templates[n % len(templates)].split()
            if len(w) > 6 and rng.random() < 0.5:
                w = [x for x in w if rng.random() > 0.06]
            around = lambda: [AROUND[i] for i in rng.integers(0, len(AROUND), rng.integers(0, 6))]
            text = " ".join([*around(), *w, *around()] if rng.random() < 0.6 else w)
            texts.append(text.upper() if rng.random() < 0.05 else text)
            kinds.append(FAMILIES.index(f))
    return texts, kinds


def _units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and their counts of the windows of each text (of one line), and the text of each window."""
    u = Units([t.replace("\n", " ").encode() for t in texts])
    return *u.features(), u.text


def _regression(feature: np.ndarray, count: np.ndarray, kinds: np.ndarray, rounds: int = 25) -> Model:
    """Multinomial logistic regression by adaptive gradient steps; the unknown class weighs as much as half of the others."""
    n, k = len(count), len(FAMILIES)
    used, local = np.unique(feature, return_inverse=True)
    w, total = np.zeros((len(used), k), np.float32), np.zeros((len(used), k), np.float32)
    begin = np.cumsum(count) - count
    by_feature = np.argsort(local, kind="stable")
    own, feature_begin = np.repeat(np.arange(n), count)[by_feature], np.searchsorted(local[by_feature], np.arange(len(used)))
    weight = np.where(kinds == 0, 0.5 * (kinds > 0).sum() / max((kinds == 0).sum(), 1), 1.0).astype(np.float32)[:, None]
    want, scale = np.eye(k, dtype=np.float32)[kinds], (1 / np.sqrt(count)).astype(np.float32)[:, None]
    bias, bias_total = np.zeros(k, np.float32), np.zeros(k, np.float32)
    for _ in range(rounds):
        z = np.add.reduceat(w[local], begin) * scale + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - want) * weight
        grad = np.add.reduceat((error * scale)[own], feature_begin) + 0.02 * w
        total += grad * grad
        w -= 0.5 * grad / (np.sqrt(total) + 1e-6)
        g = error.sum(axis=0)
        bias_total += g * g
        bias -= 0.2 * g / (np.sqrt(bias_total) + 1e-6)
    weights = np.zeros((FEATURES, k), np.float32)
    weights[used] = w
    return Model(weights, bias)


def paragraphs(docs: DataFrame, at_most: int) -> list[str]:
    """Lines of a sample of documents (a share of the doc_ids' hashes that holds about ``at_most``), those of smallest hash."""
    some = max(1.0, docs.count() / max(at_most // 4, 1))  # a document has some four lines at least: the share is wide enough
    own = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) / some))
    lines = own.select(F.explode(F.split("text", "\n")).alias("p")).where(F.trim("p") != "").distinct()
    return [r.p for r in lines.orderBy(F.xxhash64("p"), "p").limit(at_most).collect()]


def fit(docs: DataFrame, negatives: int = 8000, each: int = 120, seed: int = 11) -> Model:
    """Train on template variants and at most ``negatives`` corpus lines that resemble no template, whole.

    A first model leaves out each family's last template and a fifth of the lines: on those the temperature is fitted
    and the recall of unseen wording measured.  The model itself is trained on everything.
    """
    rng = np.random.default_rng(seed)
    other = [x for x in paragraphs(docs, negatives) if all(similarity(f, x) < 0.5 for f in TEMPLATES)]
    other += [" ".join(AROUND[i] for i in rng.integers(0, len(AROUND), rng.integers(1, 14))) for _ in range(400)]
    other = [x for x in other if _WORD.search(x.lower().encode().decode("latin-1"))]
    apart = rng.random(len(other)) < 0.2

    def trained(held: bool | None, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts, kinds = _variants(rng, each if held is not True else each // 4, held)
        feature, count, text = _units(texts + lines)
        return feature, count, np.array(kinds + [0] * len(lines))[text]

    first = _regression(*trained(False, [x for x, a in zip(other, apart) if not a]))
    feature, count, kinds = trained(True, [x for x, a in zip(other, apart) if a])
    best = (np.inf, 1.0)
    for t in np.geomspace(0.25, 4, 25):  # the temperature of least loss on what was held out
        first.temperature = float(t)
        p = first.probabilities(feature, count)
        best = min(best, (float(-np.log(np.maximum(p[np.arange(len(kinds)), kinds], 1e-12)).mean()), float(t)))
    likeliest = first.probabilities(feature, count).argmax(axis=1)
    recall = {f: float((likeliest[kinds == i] == i).mean()) for i, f in enumerate(FAMILIES) if (kinds == i).any()}
    model = _regression(*trained(None, other))
    model.temperature, model.recall = best[1], recall
    return model


def scan(docs: DataFrame, model: Model, confirm: float = 0.6, least: float = 0.1) -> DataFrame:
    """doc_id, family, probability, similarity, paragraph, n_paragraphs, families of every document.

    Lines are classified, and blocks of lines between blank ones, long ones in overlapping windows.  A family counts if
    its probability is ``least`` or more, the unknown class is not the likeliest, and a template confirms it by
    ``confirm``; a block counts for families that none of the text's lines has.  family is that of the likeliest
    confirmed line (of equal ones the first), else block, 'none' without one; families has all confirmed ones;
    paragraph: the line where it begins; n_paragraphs: lines.  A null or empty text has none; texts of any length are
    scanned whole; repeated rows are scanned alike; rows without doc_id are left out; an empty table gives an empty
    result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            ids, texts = b["doc_id"].to_pylist(), b["text"].to_pylist()
            sizes, i = np.cumsum([len(x) + 1 for x in texts]), 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + (1 << 20))))
                yield classify(m, ids[i:j], texts[i:j])
                i = j

    def classify(m: Model, ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        units = Units(texts)
        p = m.probabilities(*units.features())
        found: dict[int, dict[str, tuple]] = {}
        for at in np.flatnonzero(p.argmax(axis=1) > 0).tolist():  # lines first, then blocks
            said, own = units.said(at), found.setdefault(int(units.text[at]), {})
            for kind in np.flatnonzero(p[at] >= least).tolist():
                family = FAMILIES[kind]
                if kind and (s := similarity(family, said)) >= confirm:
                    rank = (bool(units.block[at]), -float(p[at, kind]), int(units.line[at]), family, s)
                    own[family] = min(own.get(family, rank), rank)
        best = [min(found[t].values()) if found.get(t) else (None, None, None, "none", None) for t in range(len(texts))]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([x[3] for x in best]), pa.array([None if x[1] is None else -x[1] for x in best], pa.float64()), pa.array([x[4] for x in best], pa.float64()), pa.array([x[2] for x in best], pa.int64()), pa.array([t.count(b"\n") + 1 if t else 0 for t in texts], pa.int64()), pa.array([sorted(found.get(t, {})) for t in range(len(texts))], pa.list_(pa.string()))],
            ["doc_id", "family", "probability", "similarity", "paragraph", "n_paragraphs", "families"],
        )

    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return own.mapInArrow(read, RESULT)
