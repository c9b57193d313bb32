"""License scans: a trained paragraph classifier, confirmed against templates."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .words import slices, word_codes

# Notices of common licence families, as their publishers word them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ),
    "lgpl-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ),
    "bsd-3-clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "proprietary": (
        "All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
    ),
}
# How texts speak of licences that are in no family.
OTHER_NOTICES = (
    "Licensed under the {} License, version {}.", "This work is released under the {} Public License.",
    "Use of this file is governed by the {} license agreement.", "Distributed under the terms of the {} Licence {}.",
    "Permission to use this work is granted under the {} terms.",
)
NONE, UNKNOWN = "none", "unknown"
FAMILIES = tuple(sorted(TEMPLATES))
CLASSES = (*FAMILIES, NONE, UNKNOWN)
DIMS = 1 << 14  # hashed word and word-pair features
NEGATIVES = 3000  # corpus paragraphs that the model learns as no licence
SURE = 0.5  # calibrated probability a family, or any licence, must have
CONFIRM = 0.6  # share of the shorter side's word triples that a template must share with the paragraph
MARKS = re.compile(r"[^\w.+-]+|(?<!\d)[.]|[.](?!\d)")


def notice_words(text: str) -> list[str]:
    return [w for w in MARKS.sub(" ", text.lower()).split() if w]


def _word_hash(chunk: bytes) -> int:
    """Of a blank-separated chunk; marks at its ends do not count."""
    return xxhash.xxh64_intdigest(" ".join(notice_words(chunk.decode())).encode(), 5)


def _features(offsets: np.ndarray, codes: np.ndarray, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and pairs of paragraphs: (feature, paragraph, features in each paragraph)."""
    h = np.fromiter(map(_word_hash, chunks), np.uint64, len(chunks))[codes] if len(codes) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    two = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> np.uint64(20)
    pair = owner[:-1] == owner[1:]
    feature = np.concatenate([h % np.uint64(DIMS), two[pair] % np.uint64(DIMS)]).astype(np.int64)
    whose = np.concatenate([owner, owner[:-1][pair]])
    return feature, whose, np.bincount(whose, minlength=len(offsets) - 1)


def _triples(words: list[str]) -> set[tuple[str, ...]]:
    n = min(3, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


@dataclass(frozen=True)
class LicenseModel:
    weights: np.ndarray  # DIMS x classes
    offset: np.ndarray
    heat: float  # temperature, fitted on held-out paragraphs

    def probabilities(self, paragraphs: pa.Array) -> np.ndarray:
        feature, whose, n = _features(*word_codes(paragraphs))
        z = np.empty((len(paragraphs), len(self.offset)))
        for c in range(z.shape[1]):
            z[:, c] = np.bincount(whose, self.weights[feature, c], minlength=len(paragraphs))
        z = (z / np.sqrt(np.maximum(n, 1))[:, None] + self.offset) / self.heat
        z[n == 0] = np.where(np.array(CLASSES) == NONE, 0, -50)  # no words: no licence
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _examples(negatives: list[str], rng: np.random.Generator) -> list[tuple[str, int]]:
    """Notices with words lost, cut or added, notices of made-up licences, and corpus paragraphs that match no template."""
    noise = [w for t in negatives[:200] for w in t.split()][:4000] or ["lorem", "ipsum", "dolor", "amet"]
    some = lambda n: [str(noise[i]) for i in rng.integers(0, len(noise), n)]
    out = []
    for c, family in enumerate(FAMILIES):
        for text in TEMPLATES[family]:
            for k in range(40):
                words = text.split()
                if k % 4 == 1 and len(words) > 6:
                    words = [w for w in words if rng.random() > 0.1]
                if k % 4 == 2:
                    words = some(rng.integers(1, 12)) + words + some(rng.integers(0, 6))
                if k % 4 == 3 and len(words) > 8:
                    words = words[: rng.integers(7, len(words))]
                out.append((" ".join(words), c))
    for k in range(400):
        name = " ".join(w.title() for w in some(rng.integers(1, 3)))
        out.append((OTHER_NOTICES[k % len(OTHER_NOTICES)].format(name, rng.integers(1, 9)), CLASSES.index(UNKNOWN)))
    out += [(t, CLASSES.index(NONE)) for t in negatives if best_template(t)[1] < 0.3]
    return out


def best_template(text: str) -> tuple[str, float]:
    """The family whose template shares most word triples with the paragraph, and that share of the shorter one."""
    mine, best = _triples(notice_words(text)), ("", 0.0)
    for family in FAMILIES:
        for t in TEMPLATES[family]:
            theirs = _triples(notice_words(t))
            both = len(mine & theirs)
            share = both / max(1, min(len(mine), len(theirs)))
            if share > best[1]:
                best = (family, share)
    return best


def train(negatives: list[str], seed: int = 3) -> LicenseModel:
    """Softmax regression over hashed word n-grams by gradient descent; a quarter of the examples fits the temperature."""
    rng = np.random.default_rng(seed)
    data = _examples(negatives, rng)
    x, whose, n = _features(*word_codes(pa.array([t for t, _ in data], pa.large_string())))
    y = np.array([c for _, c in data])
    scale = 1 / np.sqrt(np.maximum(n, 1))
    learn = rng.random(len(y)) < 0.75
    weights, offset = np.zeros((DIMS, len(CLASSES))), np.zeros(len(CLASSES))
    share = np.bincount(y[learn], minlength=len(CLASSES)).astype(float)
    balance = (learn / np.maximum(share, 1)[y]) / len(CLASSES)
    target = np.eye(len(CLASSES))[y]

    def scores():
        z = np.stack([np.bincount(whose, weights[x, c], minlength=len(y)) for c in range(len(CLASSES))], axis=1)
        return z * scale[:, None] + offset

    def soft(z):
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    total_w, total_o = np.full_like(weights, 1e-8), np.full_like(offset, 1e-8)
    for _ in range(60):
        d = (soft(scores()) - target) * balance[:, None]
        g = np.stack([np.bincount(x, (d[:, c] * scale)[whose], minlength=DIMS) for c in range(len(CLASSES))], axis=1) + 1e-5 * weights
        total_w += g * g
        total_o += d.sum(0) ** 2
        weights -= 0.5 * g / np.sqrt(total_w)
        offset -= 0.5 * d.sum(0) / np.sqrt(total_o)
    z, rest = scores()[~learn], y[~learn]
    loss = {h: -np.log(soft(z / h)[np.arange(len(rest)), rest] + 1e-12).mean() for h in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
    return LicenseModel(weights.astype(np.float32), offset, min(loss, key=loss.get))


def sample_paragraphs(docs: DataFrame, text_col: str = "text", size: int = NEGATIVES) -> list[str]:
    """About ``size`` paragraphs, drawn by a hash; the bound is on what the driver gets."""
    lines = docs.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("p")).where("trim(p) != ''")
    n = lines.count()
    drawn = lines.where(F.pmod(F.xxhash64("p"), F.lit(1 << 24)) < int(min(1.0, size / max(1, n)) * (1 << 24)))
    return sorted(r[0] for r in drawn.select(F.substring("p", 1, 2000).alias("p")).limit(2 * size).collect())


def _scan(model: LicenseModel):
    def run(batches):
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                parts = pc.split_pattern(texts, "\n")
                paragraphs = pc.list_flatten(parts)
                counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(texts)), counts)
                p = model.probabilities(paragraphs)
                licensed = 1 - p[:, CLASSES.index(NONE)]
                found: list[dict[str, float]] = [{} for _ in range(len(texts))]
                unknown, real = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                np.add.at(real, owner, (pc.utf8_length(pc.utf8_trim_whitespace(paragraphs)).to_numpy(zero_copy_only=False) > 0).astype(int))
                for k in np.flatnonzero(licensed >= SURE).tolist():
                    best = int(p[k].argmax())
                    family, share = best_template(paragraphs[k].as_py())
                    sure = p[k, best] >= SURE and CLASSES[best] in TEMPLATES
                    if sure and family == CLASSES[best] and share >= CONFIRM:
                        mine = found[owner[k]]
                        mine[family] = max(mine.get(family, 0.0), float(p[k, best]))
                    else:
                        unknown[owner[k]] += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(real), pa.array([sorted(f) for f in found], pa.list_(pa.string())),
                     pa.array(unknown), pa.array([max(f.values(), default=0.0) for f in found], pa.float64())],
                    ["doc_id", "n_paragraphs", "licenses", "n_unknown", "score"])
    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_paragraphs, licenses, n_unknown, score)``, one row for each row of ``docs``.

    Every paragraph (line) of every whole text is classified by its words and word pairs.  ``licenses`` are the
    families that the model is sure of (calibrated probability of ``SURE``) and a template of the same family
    confirms; a paragraph that looks like a licence but is not confirmed counts in ``n_unknown``.  ``score`` is the
    highest probability of a confirmed family.

    A null or empty text has no paragraph; an empty table gives no rows; repeated rows are scanned each.
    """
    model = train(sample_paragraphs(docs, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(model), "doc_id long, n_paragraphs long, licenses array<string>, n_unknown long, score double")
