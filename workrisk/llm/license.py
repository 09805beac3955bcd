"""Licence scan with a trained paragraph classifier (operator 5).

Paragraphs are the lines of a text; runs of lines between blank lines, of up to ``RUN_WORDS``
words, are examined too, so that a wrapped notice is seen as a whole (reported by the run's
first line; separate runs of one notice count each). Word n-grams (one to three words, hashed) feed a sparse
multinomial logistic regression over licence families and an ``unknown`` class. It is
trained on variants of short templates (words lost, swapped and put around them) against
paragraphs of the documents, a bounded sample of ``SAMPLE_DOCS`` documents. The logits are
calibrated by a temperature fitted on held-out paragraphs, so the probability of
``unknown`` can be relied on; a licence is predicted where the probability of all families is
at least ``CONFIDENCE``. Template comparison confirms the families, the most probable first: a
template of the family has at least ``SIMILARITY`` of its word pairs, by weight of rarity, in
the paragraph, not counting the pairs of families confirmed before.

Defined results: null and empty texts have no paragraphs and no licence; a document's
families are listed once, in alphabetical order; repeated rows give repeated results.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, hash_sample, mix64, pieces, text_bytes, word_hashes

UNKNOWN = "unknown"
SLOTS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE_DOCS = 400
VARIANTS = 60
CONFIDENCE = 0.5
SIMILARITY = 0.6
RUN_WORDS = 90  # the longest template has some 40 words

# Short notices by licence family, as licences and package files print them.
TEMPLATES = {
    "Apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met", "Released under the BSD License.",
            "Use of this source code is governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.",
              "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons "
                 "Attribution-NonCommercial 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.",
            "Released into the public domain under CC0 1.0."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License", "Licensed under the GNU Lesser General Public License, version 2.1."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a "
            "copy of this software and associated documentation files", "Licensed under the MIT license",
            "SPDX-License-Identifier: MIT"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "Licensed under the Mozilla Public License, version 2.0."],
    "Proprietary": ["Copyright. All rights reserved.", "All rights reserved. No part of this publication may be "
                    "reproduced without the prior written permission of the publisher."],
}
WORD = re.compile(r"[^\W_]+")


def paragraph_offsets(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the lines of all rows; and the row of each line."""
    cuts = np.union1d(np.flatnonzero(flat == 10) + 1, offsets)
    return cuts, np.searchsorted(offsets, cuts[:-1], side="right") - 1


def slot_features(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the word n-grams of each row of a buffer, and the row of each; digits count as one word."""
    word, row = word_hashes(flat, offsets)
    slots, rows = [], []
    gram = np.zeros(len(word), dtype=np.uint64)
    for order in ORDERS:
        n = len(word) - order + 1
        if n <= 0:
            break
        gram = mix64(gram[:n] * np.uint64(0x9E3779B97F4A7C15) + word[order - 1:])
        same = row[:n] == row[order - 1:]
        slots.append((gram[same] >> np.uint64(20)) % np.uint64(SLOTS))
        rows.append(row[:n][same])
    if not slots:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(slots).astype(np.int64), np.concatenate(rows)


@dataclass
class Scanner:
    classes: list[str]          # the last one is UNKNOWN
    weight: np.ndarray          # SLOTS x classes
    bias: np.ndarray
    temperature: float
    pair_weight: dict[tuple[str, str], float]

    def logits(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        slots, rows = slot_features(flat, offsets)
        n = len(offsets) - 1
        out = np.zeros((n, len(self.classes)))
        for c in range(len(self.classes)):
            out[:, c] = np.bincount(rows, weights=self.weight[:, c][slots], minlength=n)
        count = np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
        return out / count[:, None] + self.bias

    def probabilities(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return softmax(self.logits(flat, offsets) / self.temperature)

    def similarity(self, family: str, text: str) -> float:
        """Largest share of a template's word pairs, by weight, that the paragraph has."""
        return self.share(family, set(word_pairs(text)))

    def share(self, family: str, own: set) -> float:
        return max((sum(self.pair_weight[p] for p in t if p in own) / max(sum(self.pair_weight[p] for p in t), 1e-9)
                    for t in map(word_pairs, TEMPLATES[family])), default=0.0)


    def confirmed(self, text: str, p: np.ndarray) -> list[tuple[str, float]]:
        """Families whose templates the text has, with their probabilities ``p``."""
        own, out = set(word_pairs(text)) | choices(text), []
        for c in np.argsort(-p[:-1], kind="stable").tolist():
            family = self.classes[c]
            if self.share(family, own) >= SIMILARITY:
                out.append((family, float(p[c])))
                own -= {x for t in TEMPLATES[family] for x in word_pairs(t)}
        return out

    def wrapped(self, lines: list[str], known: list[set]) -> list[tuple[str, int, float]]:
        """(family, first line, probability) of notices that only runs of a block's lines hold.

        ``known``: families found in each line; it takes those found here."""
        words = [[w for w in WORD.findall(x.lower()) if not w.isdigit()] for x in lines]
        flat = [(w, i) for i, x in enumerate(words) for w in x]
        hit = {i for (w, i), (v, _) in zip(flat, flat[1:], strict=False) if (w, v) in self.pair_weight}
        out = []
        for start in sorted(hit):
            total = len(words[start])
            for end in range(start + 1, len(lines)):
                total += len(words[end])
                if total > RUN_WORDS and end > start + 1:
                    break
                if end not in hit and end - 1 not in hit:
                    continue
                text = "\n".join(lines[start:end + 1])
                pairs = set(word_pairs(text)) | choices(text)
                seen = set().union(*known[start:end + 1])
                if all(self.share(f, pairs) < SIMILARITY for f in self.classes[:-1] if f not in seen):
                    continue
                p = self.probabilities(*batch_of([text]))[0]
                new = [x for x in self.confirmed(text, p) if x[0] not in seen] if 1 - p[-1] >= CONFIDENCE else []
                # a tighter run says so as well: it starts at a later line
                inner = "\n".join(lines[start + 1:end + 1])
                new = [x for x in new if self.share(x[0], set(word_pairs(inner)) | choices(inner)) < SIMILARITY]
                for family, value in new:
                    out.append((family, start, value))
                    for k in known[start:end + 1]:
                        k.add(family)
        return out


def choices(text: str) -> set[tuple[str, str]]:
    """Word pairs that a choice ('the MIT or Apache license') leaves unsaid."""
    words = ["", "", *(w for w in WORD.findall(text.lower()) if not w.isdigit()), "", ""]
    out = set()
    for i in range(2, len(words) - 2):
        if words[i] in ("or", "and"):
            out |= {(words[i - 2], words[i + 1]), (words[i - 1], words[i + 2])}
            if "identifier" in words[:i]:  # an SPDX expression
                out.add(("identifier", words[i + 1]))
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def word_pairs(text: str) -> list[tuple[str, str]]:
    """Neighbouring words in lower case, versions left out."""
    words = [w for w in WORD.findall(text.lower()) if not w.isdigit()]
    return list(zip(words, words[1:], strict=False)) or [(w, "") for w in words]


def variant(r: random.Random, text: str, filler: list[str]) -> str:
    """A template with changed numbers, few words lost, and words put before and after."""
    words = [re.sub(r"\d+", str(r.randint(1, 4)), w) for w in text.split(" ")]
    if len(words) > 6:
        words = [w for w in words if r.random() > 0.06]
    if len(words) > 25 and r.random() < 0.5:
        words = words[:r.randint(12, len(words))]
    out = " ".join(words)
    out = out.upper() if r.random() < 0.05 else out.rstrip(".") if r.random() < 0.2 else out
    extra = [r.choice(filler) for _ in range(r.randint(0, 12))] if filler and r.random() < 0.4 else []
    cut = r.randint(0, len(extra))
    return " ".join([*extra[:cut], out, *extra[cut:]])


def batch_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


def train(paragraphs: list[str], seed: int = 3, epochs: int = 8) -> Scanner:
    """Fit on template variants and on ``paragraphs`` of documents, the unknown class."""
    r = random.Random(seed)
    classes = [*sorted(TEMPLATES), UNKNOWN]
    weights: dict[tuple[str, str], float] = {}
    for family in classes[:-1]:
        for p in {p for t in TEMPLATES[family] for p in word_pairs(t)}:
            weights[p] = weights.get(p, 0) + 1
    weights = {p: 1 / n for p, n in weights.items()}  # pairs of few families tell them apart
    scanner = Scanner(classes, np.zeros((SLOTS, len(classes))), np.zeros(len(classes)), 1.0, weights)
    # licences among the documents' own paragraphs don't train the unknown class
    plain = [p for p in paragraphs if max(scanner.similarity(f, p) for f in classes[:-1]) < SIMILARITY]
    filler = [w for p in plain for w in p.split(" ")][:20_000]
    texts = [variant(r, t, filler) for f in classes[:-1] for t in TEMPLATES[f] for _ in range(VARIANTS)]
    labels = [i for i, f in enumerate(classes[:-1]) for _ in TEMPLATES[f] for _ in range(VARIANTS)]
    texts += plain
    labels += [len(classes) - 1] * len(plain)
    order = r.sample(range(len(texts)), len(texts))
    texts, y = [texts[i] for i in order], np.array([labels[i] for i in order])
    held = len(texts) // 5
    flat, offsets = batch_of(texts)
    slots, rows = slot_features(flat, offsets)
    by_row = np.argsort(rows, kind="stable")
    slots, begin = slots[by_row], np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(texts)))])
    scale = 1 / np.sqrt(np.maximum(np.diff(begin), 1))
    squares = np.full((SLOTS, len(classes)), 1e-3)
    train_rows = np.arange(held, len(texts))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(train_rows)
        for start in range(0, len(train_rows), 64):
            part = train_rows[start:start + 64]
            own = np.concatenate([slots[begin[i]:begin[i + 1]] for i in part])
            owner = np.repeat(np.arange(len(part)), np.diff(begin)[part])
            z = np.zeros((len(part), len(classes)))
            np.add.at(z, owner, scanner.weight[own])
            p = softmax(z * scale[part][:, None] + scanner.bias)
            p[np.arange(len(part)), y[part]] -= 1
            touched, inverse = np.unique(own, return_inverse=True)
            g = np.zeros((len(touched), len(classes)))
            np.add.at(g, inverse, (p * scale[part][:, None])[owner])
            squares[touched] += g * g
            scanner.weight[touched] -= 0.3 * g / np.sqrt(squares[touched])
            scanner.bias -= 0.02 * p.mean(axis=0)
    if held:  # temperature: the lowest held-out log loss
        f, o = batch_of(texts[:held])
        z = scanner.logits(f, o)
        loss = {t: -np.log(np.maximum(softmax(z / t)[np.arange(held), y[:held]], 1e-12)).mean()
                for t in np.geomspace(0.25, 4, 25)}
        scanner.temperature = float(min(loss, key=loss.get))
    return scanner


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Scanner:
    """Fit on a bounded sample of documents and at most 40 paragraphs of each."""
    rows = docs.where(F.octet_length(text_col) <= 65_536).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    texts = [r["t"] for r in hash_sample(rows, "id", sample_docs).collect()]
    return train([p for t in texts for p in t.split("\n")[:40] if p.strip()])


def scan(df: DataFrame, scanner: Scanner, text_col: str = "text") -> DataFrame:
    """Append n_paragraphs, n_license (confirmed paragraphs), families, paragraphs (their numbers) and confidence.

    ``confidence`` is the highest calibrated probability among confirmed paragraphs, 0 without one."""
    bc = df.sparkSession.sparkContext.broadcast(scanner)  # SLOTS weights for each class

    def run(columns):
        s = bc.value
        flat, offsets = text_bytes(columns[0])
        rows = len(offsets) - 1
        total, found = np.zeros(rows, np.int64), [[] for _ in range(rows)]
        for a, b in pieces(offsets):
            part = flat[offsets[a]:offsets[b]]
            lines, owner = paragraph_offsets(part, offsets[a:b + 1] - offsets[a])
            if len(lines) < 2:
                continue
            filled = np.maximum.reduceat((part > 32).astype(np.int8), lines[:-1]) > 0
            number = np.cumsum(filled) - filled
            first = np.full(b - a, 0)
            per = np.bincount(owner[filled], minlength=b - a)
            first[1:] = np.cumsum(per)[:-1]
            total[a:b] = per
            p = s.probabilities(part, lines)
            known = [set() for _ in range(len(p))]
            line = lambda i: part[lines[i]:lines[i + 1]].tobytes().decode("utf-8", "replace")
            for i in np.flatnonzero((1 - p[:, -1] >= CONFIDENCE) & filled).tolist():
                for family, value in s.confirmed(line(i), p[i]):
                    known[i].add(family)
                    found[a + owner[i]].append((family, int(number[i] - first[owner[i]]), value))
            # blocks of lines between blank lines
            edge = np.ones(len(p), dtype=bool)
            edge[1:] = (owner[1:] != owner[:-1]) | ~filled[1:] | ~filled[:-1]
            begin = np.flatnonzero(edge)
            for x, y in zip(begin.tolist(), [*begin[1:].tolist(), len(p)], strict=True):
                if y - x > 1:
                    for family, i, value in s.wrapped([line(i) for i in range(x, y)], known[x:y]):
                        found[a + owner[x]].append((family, int(number[x + i] - first[owner[x]]), value))
        return [pa.array(total, pa.int64()), pa.array([len({x[1] for x in f}) for f in found], pa.int64()),
                pa.array([sorted({x[0] for x in f}) for f in found], pa.list_(pa.string())),
                pa.array([sorted({x[1] for x in f}) for f in found], pa.list_(pa.int64())),
                pa.array([max((x[2] for x in f), default=0.0) for f in found], pa.float64())]

    return append_columns(df, [text_col], [
        T.StructField("n_paragraphs", T.LongType()), T.StructField("n_license", T.LongType()),
        T.StructField("families", T.ArrayType(T.StringType())), T.StructField("paragraphs", T.ArrayType(T.LongType())),
        T.StructField("confidence", T.DoubleType())], run)
