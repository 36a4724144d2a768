"""Licence notices in documents: a trained paragraph classifier whose predictions templates confirm.

Sparse word 1- and 2-grams feed a multinomial logistic regression over licence families and the class UNKNOWN (no or
another licence).  It is fitted on variants of the templates and on a bounded sample of the corpus's own paragraphs.
A temperature calibrates its probabilities on templates and paragraphs that the fit has not seen: folds are dealt by
template and by source paragraph, with all their variants.  A paragraph whose best family stays under SURE is UNKNOWN.  A prediction counts as confirmed when the paragraph's words follow a template of that family closely.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices

#: Documented bound of the paragraphs of the corpus that stand for UNKNOWN in the fit, and of the template variants for each family.
FIT_PARAGRAPHS, VARIANTS = 4_000, 160
#: Words of a paragraph in that sample at most; longer ones are sampled piece by piece.
FIT_WORDS = 400
#: Least calibrated probability; least share of a paragraph's 2-grams that stand in one template, and least number of them.
SURE, CONFIRM, SHARED = 0.7, 0.6, 3
#: Folds of the calibration.
FOLDS = 3
UNKNOWN = "unknown"

# Sentences of licence notices and texts by family, as their authors publish them for reuse.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Except where otherwise noted, content on this site is licensed under CC BY-NC-SA 4.0 for noncommercial use.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; licensed under CC BY-SA 4.0.",
    ],
    "cc0": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}

_TOKENS = re.compile(r"[^\W_]+(?:\.\d+)*").findall
_END = re.compile(r"[.!?:;][\"')\]]*\s*$")


def words_of(text: str) -> list[str]:
    return _TOKENS(text.lower())


def paragraphs(text: str | None) -> list[str]:
    """Lines, where a line that ends in the middle of a sentence goes on in the next; blank lines part."""
    out: list[str] = []
    open_line = False
    for line in (text or "").split("\n"):
        if not line.strip():
            open_line = False
            continue
        if open_line:
            out[-1] += " " + line
        else:
            out.append(line)
        open_line = not _END.search(line)
    return out


def grams(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:], strict=False))}


def pairs(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False)) or Counter(words)


@dataclass
class Model:
    families: list[str]  # the last class is UNKNOWN
    place: dict[str, int]
    weights: np.ndarray  # features x classes
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, found: list[int]) -> np.ndarray:
        logits = (self.bias + self.weights[found].sum(axis=0) / max(1.0, len(found) ** 0.5)) / self.temperature
        p = np.exp(logits - logits.max())
        return p / p.sum()


def _fit_logistic(x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by accelerated gradient steps; classes weigh alike."""
    weight = (1 / np.bincount(y, minlength=classes).clip(1))[y]
    weight /= weight.sum()
    w = np.zeros((x.shape[1] + 1, classes), np.float32)
    ahead, x1 = w.copy(), np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    target = np.eye(classes, dtype=np.float32)[y]
    rate = 20.0
    for t in range(steps):
        z = x1 @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gradient = x1.T @ ((p - target) * weight[:, None].astype(np.float32))
        gradient[:-1] += ridge * ahead[:-1]
        new = ahead - np.float32(rate / (1 + t / 100)) * gradient
        ahead = new + np.float32(t / (t + 3) * 0.9) * (new - w)
        w = new
    return w[:-1], w[-1]


def fit(corpus: list[str], templates: dict[str, list[str]] = TEMPLATES, seed: int = 7) -> Model:
    """From template variants and paragraphs of the corpus; those that hold most of a template are left out of UNKNOWN."""
    rng = random.Random(seed)
    families = sorted(templates)
    known = [(f, words_of(t)) for f in families for t in templates[f]]
    wholes = [pairs(w) for _, w in known]
    plain = [w for w in map(words_of, corpus) if w and not any(_like(pairs(w), t) >= 0.3 for t in wholes)]
    common = Counter(g for w in plain for g in grams(w))
    vocabulary = sorted({g for _, w in known for g in grams(w) if common[g] <= 0.002 * max(1, len(plain))})
    place = {g: i for i, g in enumerate(vocabulary)}
    rows: list[tuple[list[str], int]] = []
    folds: list[int] = []  # of the template or paragraph that the row comes from
    for k, f in enumerate(families):
        own = [w for g, w in known if g == f]
        for n, w in enumerate(own):
            rows += [(w, k)] * 4
            folds += [n % FOLDS] * 4
        for _ in range(VARIANTS):
            n = rng.randrange(len(own))
            w = own[n]
            if len(w) > 12 and rng.random() < 0.4:  # a part of a long sentence
                size = rng.randint(10, len(w))
                start = rng.randint(0, len(w) - size)
                w = w[start : start + size]
            w = [x for x in w if rng.random() > 0.06] or w
            if plain and rng.random() < 0.3:  # in a paragraph with other words, of the same fold
                extra = _of_fold(plain, n % FOLDS, rng)[: rng.randint(1, 20)]
                w = w + extra if rng.random() < 0.5 else extra + w
            rows.append((w, k))
            folds.append(n % FOLDS)
    unknown = len(families)
    rows += [(w, unknown) for w in plain]
    folds += [i % FOLDS for i in range(len(plain))]
    loose = [w for _, ws in known for w in ws]
    for i in range(2 * VARIANTS):  # licence words without a licence's sentence
        w = [rng.choice(loose) for _ in range(rng.randint(1, 3))] + (_of_fold(plain, i % FOLDS, rng) if plain else [])
        rng.shuffle(w)
        rows.append((w, unknown))
        folds.append(i % FOLDS)
    x = np.zeros((len(rows), len(place)), np.float32)
    for i, (w, _) in enumerate(rows):
        found = [place[g] for g in grams(w) if g in place]
        x[i, found] = 1 / max(1.0, len(found) ** 0.5)
    y, fold = np.array([k for _, k in rows]), np.array(folds)
    logits = np.zeros((len(rows), unknown + 1), np.float32)
    for n in range(FOLDS):
        weights, bias = _fit_logistic(x[fold != n], y[fold != n], unknown + 1)
        logits[fold == n] = x[fold == n] @ weights + bias

    def loss(t: float) -> float:
        z = logits / t
        top = z.max(axis=1)
        return float((top + np.log(np.exp(z - top[:, None]).sum(axis=1)) - z[np.arange(len(z)), y]).mean())

    temperature = min((0.05 * 1.15**k for k in range(40)), key=loss)
    return Model(families, place, *_fit_logistic(x, y, unknown + 1), temperature)


def _of_fold(plain: list[list[str]], n: int, rng: random.Random) -> list[str]:
    """A paragraph of fold n, or of any if there are fewer paragraphs than folds."""
    own = range(n, len(plain), FOLDS)
    return plain[rng.choice(own)] if own else rng.choice(plain)


def _like(own: Counter, template: Counter) -> float:
    """Of the smaller of both, the share that stands in the other; zero if that is under SHARED and not the whole template."""
    shared, whole = sum((own & template).values()), sum(template.values())
    return shared / max(1, min(sum(own.values()), whole)) if shared >= min(SHARED, whole) else 0.0


def fit_on(docs: DataFrame, rows: int = FIT_PARAGRAPHS, text_col: str = "text") -> Model:
    """Fits with `rows` paragraphs of the corpus at most, those with the least hashes in about `rows` different texts chosen by hash.

    Texts are cut into paragraphs, and those into pieces of FIT_WORDS words, on the executors; only pieces come to the driver.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("length(text) > 0")
    n = texts.count()
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / max(n, 1)))
    different = texts.where(share).groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [words for x in part.column(0) for p in paragraphs(x.as_py()) for words in [words_of(p)] if words]
                yield pa.RecordBatch.from_arrays([pa.array([" ".join(w[i : i + FIT_WORDS]) for w in found for i in range(0, len(w), FIT_WORDS)], pa.string())], ["piece"])

    pieces = arrow_map(different.select("text"), cut, "piece string").distinct()
    found = [r.piece for r in pieces.orderBy(F.xxhash64("piece"), "piece").limit(rows).collect()]
    return fit(found)


def scan(docs: DataFrame, model: Model, templates: dict[str, list[str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, families array<string>, paragraphs array<int>, predicted array<string>, probabilities, similarities array<double>).

    families are the confirmed ones, sorted, each once; the other arrays list every paragraph predicted to be a licence.
    Null and empty texts have no paragraphs.  Null ids and repeated rows stay, an empty table gives no rows.
    """
    wholes = {f: [pairs(words_of(t)) for t in ts] for f, ts in templates.items()}
    single = {w for g in model.place for w in g.split(" ")}

    def judge(text: str | None) -> tuple:
        parts = paragraphs(text)
        found: list[tuple] = []
        if parts and not single.isdisjoint(words_of(text)):
            for i, part in enumerate(parts):
                words = words_of(part)
                places = [model.place[g] for g in grams(words) if g in model.place] if not single.isdisjoint(words) else []
                if not places:
                    continue  # the bias alone speaks for UNKNOWN
                p = model.probabilities(places)
                k = int(p.argmax())
                if k < len(model.families) and p[k] >= SURE:
                    own = pairs(words)
                    found.append((i, model.families[k], float(p[k]), max(_like(own, t) for t in wholes[model.families[k]])))
        return len(parts), sorted({f for _, f, _, s in found if s >= CONFIRM}), [x[0] for x in found], [x[1] for x in found], [x[2] for x in found], [x[3] for x in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        for batch in batches:
            for part in slices(batch):
                rows = [judge(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_paragraphs", "families", "paragraphs", "predicted", "probabilities", "similarities"])

    schema = "doc_id long, n_paragraphs long, families array<string>, paragraphs array<int>, predicted array<string>, probabilities array<double>, similarities array<double>"
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)
