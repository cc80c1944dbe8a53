"""License scans: a trained paragraph classifier, confirmed against templates.

Words are runs of letters, digits and the signs .+- inside them, lower-cased. Paragraphs end at blank lines; the lines of
one paragraph belong together, so wrapped notices are read as one. Each paragraph is looked at in overlapping windows of
4, 8, 20 and 48 words (the whole paragraph, if it is shorter). A sparse logistic regression (one family against the rest,
L1) on hashed word 1- to 3-grams scores a window by the sum of its grams' weights over the root of their number; sums of
windows are differences of running sums, so every word is hashed and weighed once and no part of a text is left out.

The class unknown is calibrated: on examples held out by template, a logistic curve maps the best score to the
probability that this family is right; below ``threshold`` a window is unknown. Of overlapping windows the likeliest
counts, and neighbouring ones of one family are one notice. It is confirmed if it
holds 0.6 of the word 2-grams of one template of its family, or shares six with it that are 0.6 of its own.

The model is trained here on sentences derived from short public licence notices and on ordinary ones: fixed ones and at
most ``max_negative`` lines of the corpus (those with the smallest hash).

Defined cases: null and empty texts have no paragraphs; ties between families go to the first by name, between windows
to the first; repeated rows give repeated results; an empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm.common import smallest

BITS = 18
WINDOWS = (4, 8, 20, 48)  # words; windows of a size begin a quarter of it apart
CHUNK = 1 << 18  # bytes of texts that are scored at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[128:] = True  # bytes beyond ASCII are parts of letters
_JOINS = np.zeros(256, bool)
_JOINS[[43, 45, 46]] = True  # + - .
_BYTE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)

#: Notices by family: short, public, commonly quoted forms.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "licensed under the apache license, version 2.0",
        "licensed under the apache license, version 2.0 (the license); you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis",
        "you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0",
        "spdx-license-identifier: apache-2.0",
    ),
    "bsd": (
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "use of this source code is governed by a bsd-style license that can be found in the license file",
        "released under the bsd 3-clause license",
        "spdx-license-identifier: bsd-3-clause",
    ),
    "cc-by": (
        "this work is licensed under a creative commons attribution 4.0 international license",
        "licensed under cc by 4.0",
        "licensed under cc by-sa 4.0",
        "licensed under creative commons attribution-sharealike 3.0",
    ),
    "cc-by-nc": (
        "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
        "licensed under cc by-nc 4.0",
        "licensed under cc by-nc-sa 4.0",
        "licensed under cc by-nc-nd 3.0",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license, version 3",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation",
        "this work is licensed under the gnu general public license",
        "you should have received a copy of the gnu general public license along with this program",
        "spdx-license-identifier: gpl-3.0-or-later",
    ),
    "lgpl": (
        "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license",
        "licensed under the gnu lesser general public license, version 2.1",
        "spdx-license-identifier: lgpl-2.1",
    ),
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "spdx-license-identifier: mit",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license, v. 2.0",
        "licensed under the mozilla public license, version 2.0",
    ),
    "public-domain": (
        "this is free and unencumbered software released into the public domain",
        "this work is dedicated to the public domain under cc0 1.0",
    ),
    "proprietary": (
        "all rights reserved",
        "copyright by the publisher. all rights reserved",
        "all rights reserved. no part of this publication may be reproduced without written permission",
        "this software is proprietary and confidential; unauthorized copying is strictly prohibited",
    ),
}
#: Short names by family and the forms in which they are given.
NAMES: dict[str, tuple[str, ...]] = {
    "apache": ("apache 2.0", "apache-2.0", "the apache license 2.0", "the apache software license"),
    "bsd": ("bsd-2-clause", "bsd-3-clause", "the bsd license", "the new bsd license"),
    "cc-by": ("cc by 4.0", "cc by-sa 4.0", "cc-by-4.0", "cc-by-sa-3.0", "creative commons attribution"),
    "cc-by-nc": ("cc by-nc 4.0", "cc by-nc-sa 4.0", "cc-by-nc-nd-3.0", "creative commons noncommercial"),
    "gpl": ("gpl-2.0", "gpl-3.0", "gpl-3.0-or-later", "gpl-2.0-only", "the gnu gpl", "gplv3"),
    "lgpl": ("lgpl-2.1", "lgpl-3.0-or-later", "the gnu lgpl", "lgplv3"),
    "mit": ("mit license", "the mit license", "the mit licence"),
    "mpl": ("mpl 2.0", "mpl-2.0", "the mozilla public license"),
    "public-domain": ("cc0", "cc0 1.0", "cc0-1.0", "the unlicense"),
}
FORMS = ("licensed under {}", "distributed under {}", "available under {}", "released under {}", "dedicated under {}", "license: {}", "licensing: {}", "this file is made available under {} by its authors", "the code is {} licensed")
#: Ordinary lines that share words with notices.
ORDINARY = (
    "the driver must show a licence to the officer on request", "the work of the museum is open to the public", "version 2 of the report was released in may",
    "the public library has free software courses", "he was granted permission to leave the house", "the general public was invited to the opening",
    "under the terms of the contract the work ends in june", "this work is a copy of an older painting", "you may use the garden free of charge",
    "the foundation published its yearly report", "all conditions of the lease were met", "she wrote the notice above the door", "the apache helicopter landed at noon",
    "a student at mit won the prize", "rights of way are shown on the map", "the commons debated the attribution of the funds", "a free copy of the book is included",
    "er kam mit dem zug nach hause und sprach lange mit ihr", "mit der zeit wird es besser, sagte er mit ruhe", "kaffee mit milch und brot mit butter", "sie fuhr mit", "das haus mit garten", "gemeinsam mit anderen", "the rights of the tenants", "all of them reserved a table",
    "restaurants must renew their license every year", "the film was released under a new title", "they were licensed to sell wine in the village",
)
FAMILIES = tuple(sorted(TEMPLATES))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined bytes in lower case, begin, end, paragraph, text) of the words of several texts; paragraphs are numbered
    through all texts."""
    raw = _LOWER[np.frombuffer(b"\n\n" + b"\n\n".join(texts) + b"\n\n", np.uint8)]
    alnum = _ALNUM[raw]
    word = alnum.copy()
    word[1:-1] |= _JOINS[raw[1:-1]] & alnum[:-2] & alnum[2:]
    edge = np.diff(word.view(np.int8))
    begin, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    lines = np.concatenate(([0], np.cumsum(raw == 10)))
    new = np.ones(len(begin), bool)
    new[1:] = lines[begin[1:]] - lines[end[:-1]] >= 2
    starts = np.cumsum([2, *(len(t) + 2 for t in texts)])[:-1]
    text = np.searchsorted(starts, begin, "right") - 1
    new[1:] |= text[1:] != text[:-1]
    return raw, begin, end, np.cumsum(new) - 1, text


def grams_of(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashed 1-, 2- and 3-grams that begin at each word, three rows; those beyond the last word wrap and are never summed."""
    length = end - begin
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    powers = np.cumprod(np.full(int(length.max()), _PRIME, np.uint64))
    one = _mix(np.add.reduceat(_BYTE[raw[np.repeat(begin, length) + place]] * powers[place], first))
    two = _mix(one * _PRIME + np.roll(one, -1) + np.uint64(2))
    three = _mix(two * _PRIME + np.roll(one, -2) + np.uint64(3))
    return (np.stack([one, two, three]) >> np.uint64(64 - BITS)).astype(np.int64)


def windows_of(paragraph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after the last) of every window of every paragraph; equal ones once."""
    first = np.flatnonzero(np.append(True, paragraph[1:] != paragraph[:-1]))
    size = np.diff(np.append(first, len(paragraph)))
    starts, stops = [], []
    for k, wide in enumerate(WINDOWS):
        step = wide // 4
        held = np.ones(len(size), bool) if k == 0 else size > WINDOWS[k - 1]  # the smaller size holds shorter paragraphs
        base, room = first[held], np.maximum(size[held] - wide, 0)
        n = -(-room // step) + 1
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(base, n) + np.minimum(nth * step, np.repeat(room, n))
        starts.append(at)
        stops.append(np.minimum(at + wide, np.repeat(base + size[held], n)))
    return np.concatenate(starts), np.concatenate(stops)


def examples() -> list[tuple[str, str | None, int]]:
    """(text, family, group): notices, their parts, and notices between ordinary words; ordinary lines have no family.
    A group holds what comes from one template or line."""
    rows: list[tuple[str, str | None, int]] = [(t, None, k) for k, t in enumerate(ORDINARY)]
    group, group_of_forms = len(ORDINARY), 1000
    for family, templates in TEMPLATES.items():
        for t in templates:
            w = t.split()
            rows += [(t, family, group), (" ".join(w[: max(5, 2 * len(w) // 3)]), family, group), (f"copyright 2020 the authors. {t}", family, group), (f"{t} see the file for details", family, group)]
            rows += [(" ".join(w[i : i + 8]), family, group) for i in range(4, len(w) - 7, 4)]
            before, after = ORDINARY[group % len(ORDINARY)].split(), ORDINARY[(group * 7 + 3) % len(ORDINARY)].split()
            rows += [(" ".join([*before[-n:], t, *after[:m]]), family, group) for n, m in ((2, 0), (0, 3), (3, 3), (6, 6))]
            group += 1
        for k, form in enumerate(FORMS):
            for i, name in enumerate(NAMES.get(family, ())):
                ordinary = ORDINARY[(5 * i + k) % len(ORDINARY)].split()
                rows += [(form.format(name), family, group_of_forms + k), (" ".join([*ordinary[-2:], form.format(name), *ordinary[: 1 + i % 3]]), family, group_of_forms + k)]
    return rows


class Model:
    """Weights by family, biases, the calibration of the best score, and the threshold of the unknown class."""

    def __init__(self, negative: list[str], steps: int = 200, penalty: float = 2e-4, folds: int = 4):
        rows = examples()
        for k, t in enumerate(negative):
            w = t.split()
            rows += [(t, None, 10_000 + k), *((" ".join(w[i : i + n]), None, 10_000 + k) for i, n in ((0, 4), (3, 5), (6, 8)) if len(w) >= i + n)]
        sets = []
        for text, _, _ in rows:
            raw, begin, end, _, _ = words_of([text.lower().encode()])
            g = grams_of(raw, begin, end) if len(begin) else np.zeros((3, 0), np.int64)
            sets.append(np.concatenate([g[k, : max(0, g.shape[1] - k)] for k in range(3)]))
        truth = np.array([FAMILIES.index(f) if f else -1 for _, f, _ in rows])
        group = np.array([g for _, _, g in rows])
        # scores of every row from a model that saw no row of its template
        held = np.zeros((len(rows), len(FAMILIES)))
        for fold in range(folds):
            out = group % folds == fold
            weights, bias = self._fit([s for s, o in zip(sets, out, strict=True) if not o], truth[~out], steps, penalty)
            held[out] = self._scores([s for s, o in zip(sets, out, strict=True) if o], weights, bias)
        best = held.max(axis=1)
        self.slope, self.offset = self._curve(best, held.argmax(axis=1) == truth)
        self.threshold = 0.75
        self.weights, self.bias = self._fit(sets, truth, steps, penalty)
        self.held_out = float(np.mean((self.probability(best) >= self.threshold) == (truth >= 0)))
        known = lambda f: (*TEMPLATES[f], *(form.format(name) for form in FORMS[:7] for name in NAMES.get(f, ())))
        self.pairs = [(k, frozenset(_pairs(t.encode()))) for k, f in enumerate(FAMILIES) for t in known(f)]

    @staticmethod
    def _fit(sets: list[np.ndarray], truth: np.ndarray, steps: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
        """One family against the rest by proximal gradient; positive and negative rows weigh the same."""
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        used, col = np.unique(np.concatenate(sets), return_inverse=True)
        scale = 1 / np.sqrt(np.bincount(row, minlength=len(sets)).clip(1))
        weights, bias = np.zeros((len(FAMILIES), 1 << BITS), np.float32), np.zeros(len(FAMILIES))
        for k in range(len(FAMILIES)):
            y = (truth == k).astype(float)
            share = np.where(y > 0, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max(len(y) - y.sum(), 1)))
            w, b = np.zeros(len(used)), 0.0
            for _ in range(steps):
                z = np.bincount(row, w[col], minlength=len(sets)) * scale + b
                d = (1 / (1 + np.exp(-z)) - y) * share
                w -= 8.0 * np.bincount(col, (d * scale)[row], minlength=len(used)) / len(sets)
                w = np.sign(w) * np.maximum(np.abs(w) - 2.0 * penalty, 0)
                b -= 2.0 * d.mean()
            weights[k, used], bias[k] = w, b
        return weights, bias

    @staticmethod
    def _scores(sets: list[np.ndarray], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        return np.array([weights[:, s].sum(axis=1) / np.sqrt(max(1, len(s))) + bias for s in sets]).reshape(-1, len(bias))

    @staticmethod
    def _curve(z: np.ndarray, right: np.ndarray, steps: int = 2000) -> tuple[float, float]:
        a, b = 1.0, 0.0
        for _ in range(steps):
            d = 1 / (1 + np.exp(-(a * z + b))) - right
            a, b = a - 0.05 * float((d * z).mean()), b - 0.05 * float(d.mean())
        return a, b

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * z + self.offset)))

    def notices(self, texts: list[bytes]) -> list[tuple[int, int, int, int, str, float, bool]]:
        """(text, paragraph of the text, first byte, byte after the last, family, probability, confirmed)."""
        raw, begin, end, paragraph, text = words_of(texts)
        if not len(begin):
            return []
        grams = grams_of(raw, begin, end)
        sums = np.zeros((3, len(FAMILIES), len(begin) + 1))
        for k in range(3):
            np.cumsum(self.weights[:, grams[k]], axis=1, out=sums[k, :, 1:])
        a, b = windows_of(paragraph)
        z, count = np.zeros((len(FAMILIES), len(a))), np.zeros(len(a))
        for k in range(3):
            stop = np.maximum(b - k, a)
            z += sums[k][:, stop] - sums[k][:, a]
            count += stop - a
        z = z / np.sqrt(np.maximum(count, 1)) + self.bias[:, None]
        family = z.argmax(axis=0)
        p = self.probability(z.max(axis=0))
        hits = np.flatnonzero(p >= self.threshold)
        hits = hits[np.lexsort((a[hits], -p[hits], paragraph[a[hits]]))]
        found, taken, here = [], [], -1
        start_of = {int(t): int(q) for t, q in zip(text[::-1], paragraph[::-1])}  # the first paragraph of each text
        offset = np.cumsum([2, *(len(t) + 2 for t in texts)])
        for i in hits.tolist():
            at, stop, t = int(a[i]), int(b[i]), int(text[a[i]])
            if paragraph[at] != here:
                here, taken = paragraph[at], []
            if any(at < y and x < stop for x, y in taken):
                continue
            taken.append((at, stop))
            piece = raw[begin[at] : end[stop - 1]].tobytes()
            own = set(_pairs(piece))
            shared = [(len(own & pairs), len(pairs)) for k, pairs in self.pairs if k == family[i]]
            # common words alone share a few pairs with some template: most of the template, or six that are most of the window
            sure = any(n >= 0.6 * whole or (n >= 6 and n >= 0.6 * len(own)) for n, whole in shared)
            found.append((t, int(here) - start_of[t], at, stop, FAMILIES[family[i]], float(p[i]), sure))
        # neighbouring windows of one family are one notice
        merged: list[list] = []
        for t, q, a, b, f, p, sure in sorted((t, q, at, stop, f, p, sure) for t, q, at, stop, f, p, sure in found):
            if merged and merged[-1][:2] == [t, q] and merged[-1][4] == f and a <= merged[-1][3]:
                merged[-1][3], merged[-1][5], merged[-1][6] = b, max(p, merged[-1][5]), sure or merged[-1][6]
            else:
                merged.append([t, q, a, b, f, p, sure])
        return [(t, q, int(begin[a] - offset[t]), int(end[b - 1] - offset[t]), f, p, sure) for t, q, a, b, f, p, sure in merged]


def _pairs(text: bytes) -> list[tuple[bytes, bytes]]:
    raw, begin, end, _, _ = words_of([text])
    words = [raw[a:b].tobytes() for a, b in zip(begin, end, strict=True)]
    return list(zip(words, words[1:]))


def train(docs: DataFrame, text_col: str = "text", max_negative: int = 400) -> Model:
    """``max_negative`` bounds the corpus lines that reach the driver; lines that look like notices aren't taken."""
    lines = docs.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("l")).filter("length(l) between 20 and 600")
    plain = lines.filter(~F.col("l").rlike(r"(?i)licen[cs]|copyright|spdx|permission|public domain|rights reserved|warrant"))
    return Model([r.l for r in smallest(plain.select("l"), max_negative, F.xxhash64("l"), F.col("l")).collect()])


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, first_byte, end_byte, family, probability, confirmed): every notice that a text holds."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, column, at = [], batch.column(0), batch.column(1), 0
            while at < len(column):
                part, size, first = [], 0, at
                while at < len(column) and (not part or size < CHUNK):
                    part.append(column[at].as_py())
                    size += len(part[-1])
                    at += 1
                rows += [(keys[first + t].as_py(), *rest) for t, *rest in model.notices(part)]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "paragraph", "first_byte", "end_byte", "family", "probability", "confirmed"])

    rows = docs.select(id_col, F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))
    return rows.mapInArrow(run, f"id {kind}, paragraph long, first_byte long, end_byte long, family string, probability double, confirmed boolean").withColumnRenamed("id", id_col)


def by_document(notices: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: its families, the number of confirmed notices, and the family of the likeliest one. Rows
    that repeat an id each get what all of them hold."""
    best = F.max_by("family", F.when(F.col("confirmed"), F.struct("probability", F.negative("paragraph").alias("p"), F.negative("first_byte").alias("b"))))
    found = notices.groupBy(id_col).agg(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"), F.count(F.when(F.col("confirmed"), 1)).alias("n_notices"), best.alias("family"))
    out = docs.select(id_col).join(found, id_col, "left")
    return out.select(id_col, F.coalesce("family", F.lit("unknown")).alias("family"), F.array_join(F.coalesce("families", F.array().cast("array<string>")), ";").alias("families"), F.coalesce("n_notices", F.lit(0)).alias("n_notices"))
