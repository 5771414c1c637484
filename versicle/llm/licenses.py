"""Licence scans: a trained paragraph classifier with an unknown class, confirmed against templates."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import HashCache, id_text, mix64, raw_bytes, tidy

#: Opening paragraphs and usual notices of public licences, by family.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "Distributed under the MIT software license, see the accompanying file COPYING",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache 2.0 License.", "This project is licensed under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License version 2.", "Released under the GPL, version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.", "Released under the LGPL 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL v3.", "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Licensed under the BSD 3-Clause License.", "Released under the BSD license.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "Licensed under the Mozilla Public License 2.0.", "Released under the MPL 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.", "Released under the ISC license.", "SPDX-License-Identifier: ISC",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Released under the Creative Commons Attribution license.", "Except where otherwise noted, content on this site is licensed under CC BY 3.0",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License", "Released under CC BY-SA 3.0.",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "Released under CC BY-NC-SA 3.0.", "Licensed under a Creative Commons Attribution NonCommercial license",
    ),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal.", "Dedicated to the public domain under CC0.", "SPDX-License-Identifier: CC0-1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary", "SPDX-License-Identifier: Unlicense"),
    "proprietary": ("All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.", "Copyright. All rights reserved.", "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}
#: Sentences with licence words that license nothing: training examples of the unknown class.
NOT_LICENCES = (
    "The driver had no license and the police took the car.", "You need a fishing license in this state.", "Copyright law differs from country to country.", "He asked permission to use the phone.", "The apache helicopter is used by the army.",
    "The general public is invited to the opening.", "Free software meetings take place every week.", "The source of the river is in the mountains.", "Version 2 of the game adds new levels.", "The creative commons of the village is a green.",
    "Public domain reviews are written by volunteers.", "The terms of the agreement were not published.", "A licensed electrician must do this work.", "Conditions on the road are bad.", "All rights and duties pass to the heirs.", "She was released under a bail of two thousand.",
    "This work took three years.", "The mit students won the prize.", "The university released a statement under pressure.", "No warranty was given with the used car.",
)
UNKNOWN = "unknown"
#: Size of the hashed feature space, longest word n-gram, pieces of the corpus in the training sample.
BUCKETS, NGRAM, SAMPLE_PIECES = 1 << 16, 3, 4000
#: Words in a scanned piece of a paragraph, and words from one piece's start to the next one's: of any template a
#: piece holds the whole or 41 words.
PIECE_WORDS, STRIDE = 60, 20
#: Two- and three-word n-grams that a piece and a template must have to be compared.
LEAST_GRAMS = 3

PUNCTUATION = re.compile(rb"[!-/:-@\[-`{-~]+")


def hashes_of(text: bytes, cache: HashCache) -> np.ndarray:
    """64-bit hashes of a text's words: A-Z lower-cased, ASCII punctuation and blanks between them."""
    return np.frombuffer(b"".join(map(cache.__getitem__, PUNCTUATION.sub(b" ", text.lower()).split())), np.uint64)


def paragraphs(text: bytes, cache: HashCache) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a text, and the number of words up to the end of each paragraph (line)."""
    lines = [x.split() for x in PUNCTUATION.sub(b" ", text.lower()).split(b"\n")]
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    return np.frombuffer(b"".join([cache[w] for line in lines for w in line]), np.uint64), ends


def piece_edges(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(paragraph, start, end) of the pieces of all paragraphs that have words: STRIDE apart, the last one to the end."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    counts = np.where(ends > starts, 1 + np.maximum(0, -(-(ends - starts - PIECE_WORDS) // STRIDE)), 0)
    paragraph = np.repeat(np.arange(len(ends)), counts)
    first = starts[paragraph] + STRIDE * (np.arange(len(paragraph)) - np.repeat(np.cumsum(counts) - counts, counts))
    return paragraph, first, np.minimum(first + PIECE_WORDS, ends[paragraph])


def gram_buckets(words: np.ndarray) -> list[np.ndarray]:
    """For each length up to NGRAM, the bucket of the n-gram that begins at each word."""
    found, rolled = [], np.zeros(len(words), np.uint64)
    for n in range(1, NGRAM + 1):
        rolled = rolled[: max(0, len(words) - n + 1)] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 :]
        found.append((mix64(rolled + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return found


def gram_set(words: np.ndarray) -> frozenset[int]:
    """Buckets of the two- and three-word n-grams."""
    return frozenset(np.concatenate(gram_buckets(words)[1:]).tolist())


class LicenceModel:
    """Multinomial logistic regression on hashed n-grams; probabilities are calibrated by one temperature."""

    def __init__(self, families: tuple[str, ...]):
        self.families = (UNKNOWN, *families)
        self.weight = np.zeros((BUCKETS, len(self.families)), np.float32)
        self.bias = np.zeros(len(self.families), np.float32)
        self.temperature = 1.0
        cache = HashCache()
        self.templates = {f: [gram_set(hashes_of(t.encode(), cache)) for t in TEMPLATES[f]] for f in families}

    def logits(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row for each piece [start, end) of ``words``, from running sums of the n-grams' weights."""
        total, size = np.zeros((len(starts), len(self.families))), np.zeros(len(starts), np.int64)
        for n, bucket in enumerate(gram_buckets(words)):
            sums = np.concatenate([np.zeros((1, len(self.families))), np.cumsum(self.weight[bucket], axis=0, dtype=np.float64)])
            last = np.maximum(ends - n, starts)
            total += sums[np.minimum(last, len(bucket))] - sums[np.minimum(starts, len(bucket))]
            size += last - starts
        return total / np.sqrt(np.maximum(size, 1))[:, None] + self.bias

    def fit(self, pieces: list[np.ndarray], y: np.ndarray, hold: np.ndarray, rounds: int = 80, rate: float = 0.5) -> LicenceModel:
        """Calibrated on the ``hold`` rows with weights from the others; then trained on all."""
        if hold.any() and not hold.all():
            self._train([pieces[i] for i in np.flatnonzero(~hold)], y[~hold], rounds, rate)
            own = [pieces[i] for i in np.flatnonzero(hold)]
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
            raw = self.logits(np.concatenate(own), ends - np.fromiter(map(len, own), np.int64, len(own)), ends)
            options = np.geomspace(0.25, 8, 41)
            self.temperature = float(min(options, key=lambda t: -np.log(softmax(raw / t)[np.arange(len(raw)), y[hold]] + 1e-12).mean()))
        return self._train(pieces, y, rounds, rate)

    def _train(self, pieces: list[np.ndarray], y: np.ndarray, rounds: int, rate: float) -> LicenceModel:
        grams = [np.concatenate(gram_buckets(p)) for p in pieces]
        n, classes = len(pieces), len(self.families)
        piece = np.repeat(np.arange(n), np.fromiter(map(len, grams), np.int64, n))
        firsts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, grams), np.int64, n))[:-1]])  # every piece has a word
        used, slot = np.unique(np.concatenate(grams), return_inverse=True)
        by_slot = np.argsort(slot, kind="stable")
        heads, owner = np.searchsorted(slot[by_slot], np.arange(len(used))), piece[by_slot]
        norm = 1 / np.sqrt(np.maximum(np.bincount(piece, minlength=n), 1))
        truth = np.eye(classes, dtype=np.float32)[y]
        share = 1 / np.maximum(np.bincount(y, minlength=classes), 1)[y]
        share *= n / share.sum()
        weight, bias = np.zeros((len(used), classes), np.float32), np.zeros(classes, np.float32)
        past, past_bias = np.full(weight.shape, 1e-2, np.float32), np.full(classes, 1e-2, np.float32)
        for _ in range(rounds):
            raw = np.add.reduceat(weight[slot], firsts, axis=0) * norm[:, None] + bias
            error = (softmax(raw) - truth) * share[:, None] / n
            grad = np.add.reduceat((error * norm[:, None]).astype(np.float32)[owner], heads, axis=0) + 1e-6 * weight
            past += grad**2
            weight -= rate * grad / np.sqrt(past + 1e-8)
            past_bias += error.sum(0) ** 2
            bias -= rate * error.sum(0) / np.sqrt(past_bias)
        self.weight = np.zeros((BUCKETS, classes), np.float32)
        self.weight[used], self.bias = weight, bias.astype(np.float32)
        return self

    def __call__(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: float, similar: float) -> list[tuple[int, str, float, float, bool]]:
        """(piece, family, probability, similarity, confirmed) of the pieces that are not of the unknown class.

        A piece is taken on if the unknown class has at most 1 - ``least``; of the three likeliest
        families it gets the one whose templates are nearest (then the likelier).
        """
        if not len(starts):
            return []
        p = softmax(self.logits(words, starts, ends) / self.temperature)
        found = []
        for i in np.flatnonzero(1 - p[:, 0] >= least):
            own = gram_set(words[starts[i] : ends[i]])
            near, chance, c = max((self.likeness(own, c), float(p[i, c]), c) for c in 1 + np.argsort(-p[i, 1:], kind="stable")[:3])
            found.append((int(i), self.families[c], chance, near, near >= similar))
        return found

    def likeness(self, own: frozenset[int], family: int) -> float:
        """To the nearest template of a family: shared n-grams over those of the shorter; 0 with fewer than LEAST_GRAMS."""
        return max((len(own & t) / min(len(own), len(t)) for t in self.templates[self.families[family]] if min(len(own), len(t)) >= LEAST_GRAMS), default=0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def variants(words: np.ndarray, noise: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """A template as it may stand in a text: whole, with lost or changed words, cut, or between other words, up to a full piece of them."""
    yield words
    for _ in range(3):
        kept = words[rng.random(len(words)) > 0.05]
        changed = np.where(rng.random(len(kept)) > 0.05, kept, noise[rng.integers(0, len(noise), len(kept))])
        yield changed if len(changed) else words
    if len(words) > 12:
        a = int(rng.integers(0, len(words) // 3))
        yield words[a : a + max(10, 2 * len(words) // 3)]
    for most in (12, 12, 12, PIECE_WORDS, PIECE_WORDS):
        a, b = rng.integers(0, most, 2)
        yield np.concatenate([noise[rng.integers(0, len(noise), a)], words, noise[rng.integers(0, len(noise), b)]])
    room = max(0, PIECE_WORDS - len(words))
    a = int(rng.integers(0, room + 1))
    yield np.concatenate([noise[rng.integers(0, len(noise), a)], words, noise[rng.integers(0, len(noise), room - a)]])


def sample_pieces(docs: DataFrame, sample: int) -> list[np.ndarray]:
    """Word hashes of ``sample`` pieces of (doc_id, text), in hash order, of the first documents in hash order of their ids, a tenth as many."""
    if not sample:
        return []
    first = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(1, sample // 10))
    chosen = docs.join(F.broadcast(first), "doc_id", "left_semi").select("text").distinct()  # ids first; the texts stay in tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for batch in batches:
            for text in raw_bytes(batch.column(0)):
                words, ends = paragraphs(text, cache)
                _, a, b = piece_edges(ends)
                yield pa.RecordBatch.from_arrays([pa.array([words[i:j].tobytes() for i, j in zip(a, b, strict=True) if j - i >= 3], pa.binary())], ["words"])

    found = chosen.mapInArrow(run, "words binary").distinct().orderBy(F.xxhash64("words"), "words").limit(sample)  # at most eight bytes for each word of a piece
    return [np.frombuffer(r["words"], np.uint64) for r in found.collect()]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_PIECES) -> LicenceModel:
    """A classifier of the TEMPLATES' families against ``sample`` pieces of the corpus and NOT_LICENCES.

    Pieces that share over half of a template's n-grams are left out. The temperature is fitted on
    variants of templates that the weights are not trained on (the last of each family of three or
    more) and a fifth of the other pieces. Null ids and texts, repeated rows and an empty table are
    no trouble: NOT_LICENCES are always there.
    """
    families = tuple(TEMPLATES)
    model, cache, rng = LicenceModel(families), HashCache(), np.random.default_rng(7)
    all_templates = [t for ts in model.templates.values() for t in ts if t]
    others = [hashes_of(x.encode(), cache) for x in NOT_LICENCES]
    for piece in sample_pieces(id_text(docs, id_col, text_col), sample):
        own = gram_set(piece)
        if not any(len(own & t) > 0.5 * len(t) for t in all_templates):
            others.append(piece)
    noise = np.concatenate(others)
    pieces, y, hold = list(others), [0] * len(others), [i % 5 == 4 for i in range(len(others))]
    for c, family in enumerate(families, 1):
        for number, template in enumerate(TEMPLATES[family], 1):
            for v in variants(hashes_of(template.encode(), cache), noise, rng):
                pieces.append(v)
                y.append(c)
                hold.append(number == len(TEMPLATES[family]) >= 3)
    return model.fit(pieces, np.array(y), np.array(hold))


SCHEMA = "doc_id long, paragraph long, family string, probability double, similarity double, confirmed boolean"


def scan(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, similar: float = 0.6, unconfirmed: bool = False) -> DataFrame:
    """One row per paragraph (line) and licence family found in it: the calibrated probability,
    likeness to the nearest template of that family (shared n-grams over those of the shorter), and
    whether that reaches ``similar``, of the piece where likeness and then probability are highest.
    Predictions that no template confirms count as unknown; they are returned only if
    ``unconfirmed`` is set.

    Paragraphs are scored in overlapping pieces, so that a notice is seen wherever it stands in a
    line of any length; every paragraph of every whole text is scored. Null and empty texts and
    paragraphs of the unknown class give no row; repeated rows give repeated results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # BUCKETS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, cache = pickle.loads(shared.value), HashCache()
        for batch in batches:
            rows: list[tuple] = []
            held: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1)), strict=True):
                held.append((doc_id, *paragraphs(text, cache)))
                size += len(text)
                if size > 1 << 18:
                    rows += found(fitted, held)
                    held, size = [], 0
            rows += found(fitted, held)
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    def found(fitted: LicenceModel, held: list[tuple]) -> list[tuple]:
        if not held:
            return []
        sizes = [len(w) for _, w, _ in held]
        base = np.cumsum(sizes) - sizes
        edges = [piece_edges(ends) for _, _, ends in held]
        owner = np.repeat(np.arange(len(held)), [len(e[0]) for e in edges])
        paragraph, starts, ends = (np.concatenate(x) for x in zip(*edges, strict=True))
        words = np.concatenate([w for _, w, _ in held])
        best: dict[tuple, tuple] = {}
        for first in range(0, len(starts), 10_000):  # a long text is scored in parts
            a, b = starts[first : first + 10_000] + base[owner[first : first + 10_000]], ends[first : first + 10_000] + base[owner[first : first + 10_000]]
            for i, family, p, near, sure in fitted(words[a[0] : b.max()], a - a[0], b - a[0], least, similar):
                key = int(owner[first + i]), int(paragraph[first + i]), family
                if (sure or unconfirmed) and (key not in best or (near, p) > best[key][:2]):
                    best[key] = near, p, sure
        return [(held[o][0], number, family, p, near, sure) for (o, number, family), (near, p, sure) in sorted(best.items())]

    return id_text(docs, id_col, text_col).mapInArrow(tidy(run), SCHEMA)


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, fit(docs))


QUERIES = {"op5_licenses": op5_licenses}
ORACLE_SQL: dict[str, str] = {}
