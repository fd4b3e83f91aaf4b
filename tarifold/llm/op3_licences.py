r"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are the blocks of lines between lines without words; words are runs of letters and digits, ASCII-lower-cased. Long
paragraphs are judged in windows of WINDOW words that overlap by half and run across line ends, so a wrapped notice is seen
whole and isn't lost in its surroundings. The lines of a paragraph are judged by themselves, too, so that notices on
neighbouring lines are each found. A sparse multinomial logistic
regression over the 1- to 3-grams of words gives each window a probability for every licence family and for 'unknown'. It is
trained on the templates, cut short, interrupted and set among corpus words, against a bounded sample of corpus paragraphs
as unknown; a temperature, fitted on examples it hasn't seen, calibrates the probabilities. A prediction is confirmed if
its family's best template shares at least CONFIRMED of its 3-grams with the window.

The n-grams the model knows are a sorted array of hashes of fixed size; every n-gram of every text probes it.

Cases: null, empty and wordless texts have no paragraph and no licence; several families in one text are all listed; a
paragraph of which the model calls a part a family, without template support in any part of it, is counted as unconfirmed, once for each such family; an empty table gives no rows; rows
may repeat; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifold.llm.shared import mix, sample_texts, slices, span_hashes, text_of, utf8

# Wording of common licence notices.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "The software is provided as is, without warranty of any kind, express or implied"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "You should have received a copy of the GNU General Public License along with this program"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
             "You should have received a copy of the GNU Lesser General Public License along with this library"],
    "BSD": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}
FAMILIES = list(TEMPLATES)
UNKNOWN = len(FAMILIES)
WINDOW, GRAMS, CONFIRMED, LEAST_PROBABILITY = 48, 3, 0.6, 0.5
SAMPLE_DOCS, SAMPLE_PARAGRAPHS, COPIES, EPOCHS, SEED = 300, 3000, 40, 120, 20240607
#: Letters and digits (bytes above 0x7F are letters), lower case; the rest parts words, line ends part paragraphs.
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[128:] = np.arange(128, 256)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _PLAIN[_c] = _c
    _PLAIN[bytes([_c]).upper()[0]] = _c


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the line and the paragraph of each word (counted through all texts), and the text of each paragraph."""
    plain = _PLAIN[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    solid = plain != 32
    starts = np.flatnonzero(solid & (~np.concatenate(([False], solid[:-1])) | first[:-1]))
    ends = np.flatnonzero(solid & (~np.concatenate((solid[1:], [False])) | first[1:])) + 1
    line = np.cumsum((raw == 10) | first[:-1])[starts] if len(starts) else np.zeros(0, np.int64)
    text = np.searchsorted(offsets, starts, "right") - 1
    new_line, new = (np.ones(min(len(line), 1), bool),) * 2
    if len(line):
        other = text[1:] != text[:-1]
        new_line = np.concatenate((new_line, (line[1:] != line[:-1]) | other))
        new = np.concatenate((new, (line[1:] - line[:-1] > 1) | other))
    return span_hashes(plain, starts, ends), np.cumsum(new_line) - 1, np.cumsum(new) - 1, text[new]


def grams(words: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n of 1 to GRAMS: place and hash of each n-gram that lies in one group."""
    h = np.zeros(len(words), np.uint64)
    for n in range(1, GRAMS + 1):
        k = len(words) - n + 1
        if k <= 0:
            return
        h = mix(h[:k] * np.uint64(0x100000001B3) + words[n - 1:])
        inside = np.flatnonzero(group[:k] == group[n - 1:])
        yield inside, h[inside]


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of known n-grams
    weights: np.ndarray  # a row for each, and one more for the bias; a column for each family and unknown
    temperature: float
    templates: list[list[np.ndarray]]  # 3-grams of each family's templates

    def features(self, words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of each known n-gram."""
        places, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for place, h in grams(words, group):
            likely = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, h[likely]), len(self.keys) - 1)
            hit = self.keys[at] == h[likely]
            places.append(place[likely[hit]])
            numbers.append(at[hit])
        return np.concatenate(places), np.concatenate(numbers)

    def __post_init__(self) -> None:
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def logits(self, rows: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
        """Sums of weights of the distinct n-grams of each row."""
        pairs = np.unique(rows * len(self.weights) + numbers)
        out = np.tile(self.weights[-1], (n, 1))
        np.add.at(out, pairs // len(self.weights), self.weights[pairs % len(self.weights)])
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _hashed(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return words_of(raw, np.array([0, len(raw)]))[0]


def _grams_of(words: np.ndarray) -> list[np.ndarray]:
    return [h for _, h in grams(words, np.zeros(len(words), np.int8))]


def examples(paragraphs: list[np.ndarray], rng: np.random.Generator) -> tuple[list[np.ndarray], np.ndarray]:
    """Word arrays and labels: templates whole, shortened, interrupted and embedded; corpus paragraphs as unknown."""
    xs, ys = [], []
    for y, texts in enumerate(TEMPLATES.values()):
        for t in texts:
            words = _hashed(t)
            for k in range(COPIES):
                w = words
                if k % 4 == 1:
                    w = w[rng.random(len(w)) > 0.1]
                if k % 4 == 2 and len(w) > 8:
                    w = w[:len(w) - int(rng.integers(0, len(w) // 4))]
                if k % 2 and paragraphs:
                    around = paragraphs[int(rng.integers(len(paragraphs)))][:WINDOW // 2]
                    cut = int(rng.integers(len(around) + 1))
                    w = np.concatenate((around[:cut], w, around[cut:]))
                xs.append(w)
                ys.append(y)
    xs += paragraphs
    ys += [UNKNOWN] * len(paragraphs)
    # words of the templates out of their order are no licence either
    pool = np.concatenate([_hashed(t) for texts in TEMPLATES.values() for t in texts])
    for _ in range(COPIES * 10):
        xs.append(rng.choice(pool, int(rng.integers(3, 16))))
        ys.append(UNKNOWN)
    return xs, np.array(ys)


def train(paragraphs: list[np.ndarray]) -> Model:
    """Fit on four fifths of the examples by full-batch gradient steps with momentum; the rest set the temperature."""
    rng = np.random.default_rng(SEED)
    templates = [[_grams_of(_hashed(t))[-1] for t in texts] for texts in TEMPLATES.values()]
    known = [g for texts in TEMPLATES.values() for t in texts for g in _grams_of(_hashed(t))]
    keys = np.unique(np.concatenate(known))
    model = Model(keys, np.zeros((len(keys) + 1, UNKNOWN + 1)), 1.0, templates)
    xs, ys = examples(paragraphs, rng)
    words = np.concatenate(xs)
    row = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    places, numbers = model.features(words, row)
    test = rng.random(len(xs)) < 0.2
    pairs = np.unique(row[places] * len(model.weights) + numbers)
    r, c = pairs // len(model.weights), pairs % len(model.weights)
    goal = np.eye(UNKNOWN + 1)[ys]
    weight = np.where(test, 0.0, 1 / np.bincount(ys, minlength=UNKNOWN + 1)[ys])
    weight /= weight.sum()
    velocity = np.zeros_like(model.weights)
    for _ in range(EPOCHS):
        z = np.tile(model.weights[-1], (len(xs), 1))
        np.add.at(z, r, model.weights[c])
        error = (softmax(z) - goal) * weight[:, None]
        gradient = np.zeros_like(model.weights)
        np.add.at(gradient, c, error[r])
        gradient[-1] = error.sum(axis=0)
        velocity = 0.9 * velocity - 8.0 * (gradient + 1e-6 * model.weights)
        model.weights += velocity
    z = model.logits(row[places], numbers, len(xs))[test]
    losses = {t: -np.log(softmax(z / t)[np.arange(len(z)), ys[test]] + 1e-12).mean() for t in np.linspace(0.5, 4, 36)}
    model.temperature = float(min(losses, key=losses.get))
    return model


def fit(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> Model:
    """Train with paragraphs of at most SAMPLE_DOCS documents (by a hash of the id) that don't look like a template."""
    templates = np.unique(np.concatenate([_grams_of(_hashed(t))[-1] for texts in TEMPLATES.values() for t in texts]))
    paragraphs = []
    for text in sample_texts(docs, SAMPLE_DOCS, id_column, text_column).to_pylist():
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        hashes, lines, blocks, _ = words_of(raw, np.array([0, len(raw)]))
        # each line, and the windows of each paragraph of several
        several = np.flatnonzero(np.diff(lines, prepend=-1) * (np.diff(blocks, prepend=-1) == 0))
        wide = np.unique(blocks[several])
        starts = [np.flatnonzero(np.diff(lines, prepend=-1))] + [np.arange(*np.searchsorted(blocks, (b, b + 1)), WINDOW // 2) for b in wide.tolist()]
        for group, begin in [(lines, k) for k in starts[0].tolist()] + [(blocks, k) for part in starts[1:] for k in part.tolist()]:
            words = hashes[begin:min(begin + WINDOW, int(np.searchsorted(group, group[begin], "right")))]
            found = _grams_of(words)
            if len(paragraphs) < SAMPLE_PARAGRAPHS and not (len(found) == GRAMS and np.isin(found[-1], templates).any()):
                paragraphs.append(words)
    return train(paragraphs)


def judged(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of paragraphs of each text; and of each window that a family was predicted for: text, paragraph, family, probability, template share."""
    n = len(offsets) - 1
    words, line, paragraph, text = words_of(raw, offsets)
    n_paragraphs = np.bincount(text, minlength=n)
    parts = [windows_of(model, words, paragraph)]
    if len(line) and line[-1] > paragraph[-1]:
        n_lines = np.bincount(paragraph[np.flatnonzero(np.diff(line, prepend=-1))])
        own = n_lines[paragraph] > 1  # a paragraph of one line has been judged
        parts.append(windows_of(model, words[own], line[own], paragraph[own]))
    at, family, probability, share = (np.concatenate(x) for x in zip(*parts))
    return n_paragraphs, text[at], at, family, probability, share


def windows_of(model: Model, words: np.ndarray, group: np.ndarray, paragraph: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of a group of words that a family was predicted for: paragraph (or group), family, probability, template share."""
    places, numbers = model.features(words, group)
    if not len(places):
        return *(np.zeros(0, np.int64),) * 2, *(np.zeros(0),) * 2
    begin = np.searchsorted(group, np.arange(group[-1] + 2))
    half = WINDOW // 2
    at = (places - begin[group[places]]) // half
    # each place lies in the window that begins at its own half and in the one before
    key = np.concatenate((group[places] * (1 << 32) + at, group[places] * (1 << 32) + np.maximum(at - 1, 0)))
    # windows without a known n-gram have only the bias and are unknown
    windows, rows = np.unique(key, return_inverse=True)
    z = model.logits(rows, np.concatenate((numbers, numbers)), len(windows))
    p = softmax(z / model.temperature)
    family = p.argmax(axis=1)
    good = np.flatnonzero((family != UNKNOWN) & (p.max(axis=1) >= LEAST_PROBABILITY))
    shares = np.zeros(len(good))
    for k, w in enumerate(good.tolist()):
        own, part = divmod(int(windows[w]), 1 << 32)
        a = begin[own] + part * half
        found = _grams_of(words[a:min(begin[own + 1], a + WINDOW)])
        if len(found) == GRAMS:
            shares[k] = max(np.isin(t, found[-1]).mean() for t in model.templates[family[w]])
    owner = windows[good] >> 32
    return owner if paragraph is None else paragraph[begin[owner]], family[good], p.max(axis=1)[good], shares


def scan(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, families (confirmed, in order of name), probability (of the surest, 0 if none), template_share, n_unconfirmed."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 21):
                n_paragraphs, text, paragraph, family, probability, share = judged(model, *utf8(part.column(1)))
                n = part.num_rows
                sure = share >= CONFIRMED
                families: list[set[str]] = [set() for _ in range(n)]
                for t, f in zip(text[sure].tolist(), family[sure].tolist()):
                    families[t].add(FAMILIES[f])
                called = paragraph * len(FAMILIES) + family
                bare = np.flatnonzero(~np.isin(called, called[sure]))
                unconfirmed = text[bare[np.unique(called[bare], return_index=True)[1]]]
                best, near = np.zeros(n), np.zeros(n)
                np.maximum.at(best, text[sure], probability[sure])
                np.maximum.at(near, text[sure], share[sure])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_paragraphs.astype(np.int64)), pa.array([sorted(x) for x in families], pa.list_(pa.string())), pa.array(best), pa.array(near),
                     pa.array(np.bincount(unconfirmed, minlength=n).astype(np.int64))], ["doc_id", "n_paragraphs", "families", "probability", "template_share", "n_unconfirmed"])

    return rows.mapInArrow(run, "doc_id long, n_paragraphs long, families array<string>, probability double, template_share double, n_unconfirmed long")
