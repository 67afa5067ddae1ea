"""License scans: MinHash bands over overlapping text windows, verified exactly.

Texts and templates are sets of five-word shingles.  For each size class of templates
a text is cut into windows of that many shingles and a quarter more, which overlap so
that every stretch of the class's size lies inside one window.  A template of which a
window holds 80 % then has a Jaccard similarity of about a half with it, and 32 bands
of one row retrieve it with the probability that :func:`collision_probability` gives
(over 0.99999 at a half).  What is retrieved is checked by exact containment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, hash64

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 32
ROWS = 1
#: Largest number of shingles of a template in each size class.
CLASSES = (1, 2, 4, 8, 16, 32, 64, 128)
#: Words that are scanned together, so that their hashes stay in the processor's cache.
GROUP_WORDS = 8_192
SCHEMA = (
    "doc_id long, license string, start_word int, n_words int, containment double, "
    "matched_text string"
)
_PUNCTUATION = ".,;:!?\"'()[]{}|*_#<>"

# Wording of license notices, by SPDX identifier and kind.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met"
    ),
    "CC-BY-4.0 line": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License."
    ),
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 line": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License."
    ),
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."
    ),
    "ISC permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
    "MIT line": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
        "a copy of the MPL was not distributed with this file, You can obtain one at"
    ),
    "Unlicense line": "This is free and unencumbered software released into the public domain.",
}


def collision_probability(jaccard: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Chance that two sets of this similarity share a band."""
    return 1 - (1 - jaccard**rows) ** bands


def _token(word: str) -> int:
    bare = word.strip(_PUNCTUATION)
    return hash64(bare) or 1 if bare else 0


def _shingles(words: np.ndarray) -> np.ndarray:
    count = len(words) - SHINGLE + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(SHINGLE):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : k + count]
        total ^= total >> np.uint64(31)
    return total


class Scanner:
    """Band tables of the templates, and the scan of one text after the other."""

    def __init__(self, templates: dict[str, str], bands: int = BANDS, rows: int = ROWS):
        rng = np.random.default_rng(11)
        count = bands * rows
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, count, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.cache = WordHashes(_token)
        self.names, self.sets = [], []
        for name, text in sorted(templates.items()):
            words = self.cache.array(text.lower().split())
            found = np.unique(_shingles(words[words != 0]))
            if len(found):
                self.names.append(name)
                self.sets.append(found)
        top = max([len(s) for s in self.sets], default=0)
        sizes = [c for c in CLASSES if c < top] + [max(top, 1)]
        #: (shingles of a window, stride, band filters, {(band, value): templates})
        self.classes = []
        low = 0
        for size in sizes:
            members = [i for i, s in enumerate(self.sets) if low < len(s) <= size]
            low = size
            if not members:
                continue
            size = max(len(self.sets[i]) for i in members)
            slack = max(1, -(-size // 4))
            table: dict[tuple[int, int], list[int]] = {}
            marks = np.zeros((bands, 1 << 16), bool)
            for i in members:
                keys = self._keys(self._hashes(self.sets[i]).min(axis=1, keepdims=True))
                for band, key in enumerate(keys[:, 0].tolist()):
                    table.setdefault((band, key), []).append(i)
                    marks[band, key >> 16] = True
            self.classes.append((size + slack, slack + 1, marks, table))

    def _hashes(self, shingles: np.ndarray) -> np.ndarray:
        """One row of 32-bit values per hash function."""
        return ((shingles[None, :] * self.a) >> np.uint64(32)).astype(np.uint32)

    def _keys(self, minima: np.ndarray) -> np.ndarray:
        """One row of 32-bit keys per band."""
        if self.rows == 1:
            return minima
        keys = np.zeros((self.bands, minima.shape[1]), np.uint32)
        for r in range(self.rows):
            keys = keys * np.uint32(0x9E3779B1) + minima[r :: self.rows]
        return keys

    def _candidates(self, shingles: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first shingle, shingles, template) of the windows that share a band with it."""
        widest = max((size for size, *_ in self.classes), default=0)
        n = len(shingles)
        # Filled up at the end, so that the last windows are whole.
        shingles = np.append(shingles, np.full(2 * widest, shingles[-1], np.uint64))
        doubled = {1: self._hashes(shingles)}
        bands = np.arange(self.bands)[:, None]
        for size, stride, marks, table in self.classes:
            half = 1 << (size.bit_length() - 1)
            width = 1
            while width < half:
                if 2 * width not in doubled:
                    x = doubled[width]
                    doubled[2 * width] = np.minimum(x[:, :-width], x[:, width:])
                width *= 2
            x, skip = doubled[half], size - half
            keys = self._keys(
                np.minimum(x[:, 0:n:stride], x[:, skip : n + skip : stride])
            )
            band, window = np.nonzero(marks[bands, keys >> np.uint32(16)])
            found = {
                (w * stride, size, i)
                for b, w in zip(band.tolist(), window.tolist())
                for i in table.get((b, int(keys[b, w])), ())
            }
            yield from sorted(found)

    def scan(self, texts: list[str | None]) -> Iterator[tuple]:
        """(number of the text, license, first word, words, containment, matched text).

        Of windows of one template that overlap in a text, the fullest and then the first
        counts.  The texts are scanned in groups, one after the other in one array.
        """
        group: list[tuple[int, np.ndarray, np.ndarray]] = []
        held = 0
        for number, text in enumerate(texts):
            words = self.cache.array((text or "").lower().split())
            kept = np.flatnonzero(words)
            group.append((number, words[kept], kept))
            held += len(kept)
            if held >= GROUP_WORDS:
                yield from self._scan_group(group, texts)
                group, held = [], 0
        yield from self._scan_group(group, texts)

    def _scan_group(self, group: list, texts: list[str | None]) -> Iterator[tuple]:
        bounds = np.cumsum([0] + [len(w) for _, w, _ in group])
        shingles = _shingles(np.concatenate([w for _, w, _ in group] or [np.zeros(0, np.uint64)]))
        if not len(shingles) or not self.sets:
            return
        hits: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        for start, size, i in self._candidates(shingles):
            # The window's part in each text that it touches.
            doc = int(np.searchsorted(bounds, start, "right")) - 1
            while doc < len(group) and bounds[doc] < start + size:
                low = max(start, int(bounds[doc]))
                high = min(start + size, int(bounds[doc + 1]) - SHINGLE + 1)
                inside = np.flatnonzero(np.isin(shingles[low:high], self.sets[i])) if low < high else ()
                if len(inside):
                    share = len(np.unique(shingles[low:high][inside])) / len(self.sets[i])
                    if share >= CONTAINMENT:
                        kept, base = group[doc][2], low - int(bounds[doc])
                        first = int(kept[base + int(inside[0])])
                        last = int(kept[base + int(inside[-1]) + SHINGLE - 1])
                        hits.setdefault((doc, i), []).append((-share, first, last))
                doc += 1
        rows = []
        for (doc, i), found in hits.items():
            number = group[doc][0]
            text = texts[number]
            spans = [m.span() for m in re.finditer(r"\S+", text)]
            taken: list[tuple[int, int]] = []
            for share, a, b in sorted(found):
                if all(b < x or a > y for x, y in taken):
                    taken.append((a, b))
                    piece = text[spans[a][0] : spans[b][1]]
                    rows.append((number, self.names[i], a, b - a + 1, -share, piece))
        yield from sorted(rows, key=lambda r: (r[0], r[2], r[1]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Rows of SCHEMA: each stretch of a text that holds 80 % of a template's shingles.

    ``templates`` is a parameter of bounded size and travels with the tasks.  Whole texts
    are read where they lie; nothing is shuffled.  Missing texts and texts of fewer than
    five words match nothing; repeated rows each give their matches; stretches of different
    templates may overlap; other columns are ignored; an empty table gives no rows.
    """
    given = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(given)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            ids = batch["doc_id"].tolist()
            rows = [(ids[number], *hit) for number, *hit in scanner.scan(batch["text"].tolist())]
            yield pd.DataFrame(rows, columns=names).astype(
                {"doc_id": "Int64", "containment": "float64"}
            )

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return thin.mapInPandas(run, SCHEMA)
