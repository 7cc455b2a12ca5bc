"""License scans by a trained paragraph classifier, in DataFrame expressions on the main path.

A paragraph is a line that is not blank. A sparse logistic regression over its words and word pairs scores the
licence families, the class `unknown` (licence language of no known family) and `none`. Its probabilities are
calibrated by a temperature on examples kept from training. A predicted family is confirmed by comparison with
the family's templates: the share of the shorter side's word triples that both have must reach CONFIRM; what is
not confirmed counts as unknown. The model is fitted here, on the driver, to examples made from the templates
(words dropped, cut and added, EXAMPLES of each class, from a fixed seed).

Each document is scanned within its row, so nothing is shuffled: weights are a hash table in a literal of bounded
size (at most MOST_FEATURES entries), where a feature's bucket is found by its hash.

Null texts have no paragraphs. Repeated rows have equal results; a null doc_id is a key like any other.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import let

#: The wording of common licence notices, by family; fixed values.
TEMPLATES = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.", "Licensed under the GNU Affero General Public License, version 3.", "This project is released under the GNU AGPL version 3.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0",
        "See the License for the specific language governing permissions and limitations under the License.", "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0",
    ),
    "artistic": ("This library is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.", "This program is distributed under the Artistic License, version 2.0.", "This package may be modified and redistributed under the same terms as Perl itself."),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http www boost org LICENSE 1 0 txt",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.", "Licensed under the 3-Clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.", "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "This text is available under the Creative Commons Attribution-ShareAlike License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0.",
        "To view a copy of this license, visit http creativecommons org licenses by 4.0 or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication.", "Released under CC0 1.0 Universal.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https www eclipse org legal epl v20 html", "Licensed under the Eclipse Public License, version 2.0.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This file may be distributed under the terms of the GNU General Public License version 2.", "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", "Licensed under the ISC License.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is licensed under the GNU Lesser General Public License, version 3.", "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http mozilla org MPL 2.0", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.", "Released into the public domain under the Unlicense.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "Licensed under the zlib License.",
    ),
}
#: Licence language of no known family, and other uses of its words, for training.
OTHER = ("Licensed under the Example Community License, version 1.", "All rights reserved. Use is subject to the terms of the license agreement.", "This software is proprietary and its license does not permit redistribution.", "Distributed under the terms of a custom license.", "Released under the Sample Source License.", "You may not copy this work without a license from its owner.")
NONE = ("He lost his driving license and paid the fee for a new version.", "Permission to enter was granted free of charge to any person in town.", "The public library is open under the terms of the city.", "The work of the general is in the public domain of interest.", "A copy of the file was obtained from the source.", "Apache helicopters, a BSD conference and an MIT professor were in the news.", "The software was released in May and version 3 followed.", "The eclipse was seen by the public in the open, version by version.", "He boosted the engine with permission of the owner.", "In no event will the visitors be late, said the author.", "Mozilla and the foundation published a common report.", "Conditions are met with or without modification of the plan.")
UNKNOWN, NEITHER = "unknown", "none"
#: Training examples of a class, steps of the fit, and the bound of the weights' table.
EXAMPLES, STEPS, MOST_FEATURES = 160, 150, 6000
#: A class needs this probability; a confirmed family this share of common word triples.
SURE, CONFIRM = 0.5, 0.5
WORD = "[a-z0-9]+"


def words_of(text: str) -> list[str]:
    """Words as the classifier sees them."""
    return re.findall(WORD, text.lower())


def features(words: list[str]) -> set[str]:
    """Words and word pairs."""
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


@dataclass(frozen=True)
class Model:
    """Classes, their biases, and a row of weights for each feature; scores are divided by the temperature."""

    classes: list[str]
    bias: list[float]
    weights: dict[str, list[float]]
    temperature: float


def _examples(rng: random.Random, count: int) -> list[tuple[list[str], str]]:
    filler = ["the", "of", "and", "to", "in", "is", "that", "for", "it", "on", "as", "with", "was", "by", "from", "this", "are", "or", "be", "at"]
    noise = lambda n: [rng.choice(filler) if rng.random() < 0.4 else "".join(rng.choices(["th", "er", "on", "an", "re", "he", "ti", "nd"], k=rng.randint(1, 4))) for _ in range(n)]
    made = []
    for label, texts in [*TEMPLATES.items(), (UNKNOWN, OTHER), (NEITHER, NONE)]:
        for _ in range(count * (4 if label == NEITHER else 1)):
            words = words_of(rng.choice(texts))
            if label == NEITHER and rng.random() < 0.7:
                words = noise(rng.randint(1, 60))
            elif label == UNKNOWN and rng.random() < 0.5:
                words = words_of("licensed released under the") + noise(2) + ["license", *noise(1)]
            if len(words) > 14 and rng.random() < 0.5:
                at = rng.randrange(len(words) - 9)
                words = words[at : at + rng.randint(9, len(words))]
            words = [w for w in words if rng.random() > rng.choice([0.0, 0.0, 0.1])]
            if rng.random() < 0.4:
                words = noise(rng.randint(0, 25)) + words + noise(rng.randint(0, 25))
            made.append((words, label))
    rng.shuffle(made)
    return made


@lru_cache(1)
def train(examples: int = EXAMPLES, steps: int = STEPS) -> Model:
    """The model; the same at each call."""
    made = _examples(random.Random(13), examples)
    kept, held = made[: len(made) * 4 // 5], made[len(made) * 4 // 5 :]
    counts: dict[str, int] = {}
    for words, _ in kept:
        for f in features(words):
            counts[f] = counts.get(f, 0) + 1
    names = sorted(sorted((f for f, c in counts.items() if c > 3), key=lambda f: (-counts[f], f))[:MOST_FEATURES])
    index, classes = {f: i for i, f in enumerate(names)}, [*TEMPLATES, UNKNOWN, NEITHER]

    def table(rows: list) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(names) + 1), np.float32)
        x[:, -1] = 1
        for i, (words, _) in enumerate(rows):
            x[i, [index[f] for f in features(words) if f in index]] = 1
        return x, np.eye(len(classes), dtype=np.float32)[[classes.index(label) for _, label in rows]]

    (x, y), (hx, hy) = table(kept), table(held)
    w, m, v = (np.zeros((len(names) + 1, len(classes)), np.float32) for _ in range(3))
    for step in range(1, steps + 1):
        scores = x @ w
        p = np.exp(scores - scores.max(1, keepdims=True))
        gradient = x.T @ (p / p.sum(1, keepdims=True) - y) / len(x) + 1e-4 * w
        m += 0.1 * (gradient - m)
        v += 0.01 * (gradient**2 - v)
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def loss(t: float) -> float:
        s = hx @ w / t
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - (s * hy).sum(1)).mean())

    temperature = min((round(0.5 + 0.25 * i, 2) for i in range(14)), key=loss)
    rows = {f: [round(float(z), 6) for z in w[i]] for f, i in index.items() if np.abs(w[i]).max() > 0.02}
    return Model(classes, [round(float(z), 6) for z in w[-1]], rows, temperature)


def _runs(words: Column, n: int) -> Column:
    """Runs of n words."""
    size = F.greatest(F.size(words) - n + 1, F.lit(0))
    runs = F.slice(words, F.lit(1), size)
    for k in range(2, n + 1):
        runs = F.zip_with(runs, F.slice(words, F.lit(k), size), lambda a, b: F.concat_ws(" ", a, b))
    return runs


def _literal(value, kind: str) -> Column:
    """A nested constant; Spark reads it once, when it plans."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _weights(model: Model) -> tuple[Column, int]:
    """The model's weights as buckets of (f, w), and the number of buckets."""
    count = 1 << max(4, (2 * len(model.weights)).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(count)]
    for f in sorted(model.weights):
        buckets[xxhash.xxh64_intdigest(f.encode(), seed=42) % count].append({"f": f, "w": model.weights[f]})  # as Spark's xxhash64
    return _literal(buckets, "array<array<struct<f:string,w:array<double>>>>"), count


def _classified(model: Model) -> Callable[[Column], Column]:
    """A function from a paragraph's words to its class, null for `none` and for what is not sure."""
    weights, count = _weights(model)
    names = sorted(model.weights)
    known = lambda x: x.isin(names)  # noqa: E731  a hash set of the features
    row = lambda f: F.get(F.filter(F.get(weights, F.pmod(F.xxhash64(f), F.lit(count)).cast("int")), lambda b: b["f"] == f), F.lit(0))["w"]
    bias = F.array(*map(F.lit, model.bias))

    def best(scores: Column) -> Column:
        top = F.array_max(scores)
        total = F.aggregate(scores, F.lit(0.0), lambda t, s: t + F.exp((s - top) / F.lit(model.temperature)))
        return F.when(1 / total >= SURE, F.get(F.array(*map(F.lit, model.classes)), F.array_position(scores, top).cast("int") - 1))

    def label(words: Column) -> Column:
        found = F.array_distinct(F.concat(F.filter(words, known), F.filter(_runs(words, 2), known)))
        summed = lambda fs: F.aggregate(fs, bias, lambda total, f: F.zip_with(total, row(f), lambda x, y: x + y))
        return let(found, lambda fs: F.when(F.size(fs) > 0, let(let(summed(fs), best), lambda c: F.nullif(c, F.lit(NEITHER)))))

    return label


def _confirmed(words: Column, label: Column) -> Column:
    """The label if a template of its family has enough of the words' triples, else unknown."""
    triples = lambda w: sorted({" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))})
    cut = {k: [{"t": triples(w), "n": max(1, len(w) - 2)} for w in map(words_of, texts)] for k, texts in TEMPLATES.items()}
    templates = _literal(cut, "map<string,array<struct<t:array<string>,n:int>>>")
    mine = F.array_distinct(F.when(F.size(words) < 3, F.array(F.concat_ws(" ", words))).otherwise(_runs(words, 3)))
    similar = lambda m, x: F.size(F.array_intersect(m, x["t"])) >= CONFIRM * F.least(F.size(m), x["n"])
    sure = let(mine, lambda m: F.exists(F.coalesce(F.try_element_at(templates, label), F.array()), lambda x: similar(m, x)))
    return F.when(sure, label).otherwise(F.lit(UNKNOWN))


def hits(text: str, model: Model) -> Column:
    """array<struct<pos, label>>: the paragraphs of a text column that are of a licence family or of the unknown class."""
    classify = _classified(model)
    words = lambda line: F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))
    named = lambda w: let(classify(w), lambda label: F.when(label.isNotNull(), _confirmed(w, label)))
    each = F.transform(F.split(text, "\n", -1), lambda line, pos: F.struct(pos.alias("pos"), let(words(line), named).alias("label")))
    return F.coalesce(F.filter(each, lambda h: h["label"].isNotNull()), F.array().cast("array<struct<pos:int,label:string>>"))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_licence, n_unknown, families and found (pos:family, in order) of every document."""
    out = docs.select("doc_id", hits("text", model or train()).alias("hits"))
    families = F.array_sort(F.array_distinct(F.filter(F.col("hits.label"), lambda x: x != UNKNOWN)))
    return out.select(
        "doc_id",
        F.size(F.filter("hits", lambda h: h["label"] != UNKNOWN)).cast("long").alias("n_licence"),
        F.size(F.filter("hits", lambda h: h["label"] == UNKNOWN)).cast("long").alias("n_unknown"),
        F.concat_ws(",", families).alias("families"),
        F.concat_ws(",", F.transform("hits", lambda h: F.concat_ws(":", h["pos"].cast("string"), h["label"]))).alias("found"),
    )
