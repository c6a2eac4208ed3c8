"""License scan: MinHash bands over overlapping text windows, then exact containment.

Texts and templates are compared as sets of word shingles (five lower-cased alphanumeric words).
For every size class of templates, a text has windows of WIDER times the template's words, one at
each quarter of it, so an occurrence lies whole in some window. A window's MinHash signature is cut
into bands; a window and a template that agree in one band are a candidate. With the bands below a
window that holds a template with four fifths of its shingles has a Jaccard similarity of 0.5 at
least and is retrieved with probability 1 - (1 - 0.5^2)^32 > 0.9999. Candidates are verified: the share
of the template's shingles that the window and half a template on either side hold must reach
CONTAINMENT. Signatures are only computed for windows that share a shingle with some template; no
other window can agree in a band.

Templates are a fixed list of bounded size, so they are broadcast with the code. Null and empty
texts match nothing. Rows are independent, so repeated rows agree; a match is a run of shingles, and of
overlapping ones with one template those of about its length (WIDER) go first, then the fullest, the
shortest and the earliest, so notices repeated back to back are a match each. An empty table gives an
empty result. Other columns of the input aren't read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import run_hashes

SHINGLE, CONTAINMENT, WIDER = 5, 0.8, 1.25
BANDS, ROWS = 32, 2

#: Opening notices of common licences, as their stewards publish them, and short forms in use.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)

_MAP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def shingle_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the words of mapped bytes, and the hash of the shingle that begins at each word but the last four."""
    space = np.r_[True, raw == 32, True]
    begin, end = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    word = run_hashes(raw, begin, end)
    n = max(0, len(word) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n]
    return begin, end, h ^ (h >> np.uint64(30))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set of shingles, BANDS x ROWS of them."""
    k = np.arange(BANDS * ROWS, dtype=np.uint64)
    mixed = (shingles[:, None] ^ (k * np.uint64(0xD6E8FEB86659FD93))[None]) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(32))).min(0).reshape(BANDS, ROWS)


class Templates:
    def __init__(self, templates=TEMPLATES):
        self.names = [name for name, _ in templates]
        self.shingles: list[np.ndarray] = []
        self.words: list[int] = []
        for name, text in templates:
            begin, _, h = shingle_hashes(np.frombuffer(text.encode().translate(_MAP), np.uint8))
            if not len(h):
                raise ValueError(f"the template {name} has fewer than {SHINGLE} words")
            self.words.append(len(begin))
            self.shingles.append(np.unique(h))
        self.bands = [signature(s) for s in self.shingles]
        self.every = np.unique(np.concatenate(self.shingles))
        self.sizes: dict[int, list[int]] = {}
        for i, n in enumerate(self.words):
            self.sizes.setdefault(n, []).append(i)

    def scan(self, text: str) -> list[tuple[int, float, int, int]]:
        """Template, containment and byte span of each match in the text."""
        raw = np.frombuffer(text.encode().translate(_MAP), np.uint8)
        begin, end, h = shingle_hashes(raw)
        at = np.minimum(np.searchsorted(self.every, h), len(self.every) - 1)
        hit = np.flatnonzero(self.every[at] == h)
        if not len(hit):
            return []
        starts: dict[int, set[int]] = {}
        for n, own in self.sizes.items():
            width = int(np.ceil(WIDER * n)) - SHINGLE + 1  # in shingles
            stride = max(1, n // 4)
            near = {w for x in hit.tolist() for w in range(max(0, -(-(x - width + 1) // stride)), x // stride + 1)}
            for w in sorted(near):
                a = w * stride
                window = h[a : a + width]
                if not len(window):
                    continue
                bands = signature(np.unique(window))
                for i in own:
                    if not (bands == self.bands[i]).all(1).any():
                        continue
                    lo, hi = max(0, a - n // 2), min(len(h), a + width + n // 2)
                    inside = np.isin(h[lo:hi], self.shingles[i])
                    share = len(np.unique(h[lo:hi][inside])) / len(self.shingles[i])
                    if share >= CONTAINMENT:
                        starts.setdefault(i, set()).update((lo + np.flatnonzero(inside)).tolist())
        out = []
        for i, own in starts.items():
            places = np.flatnonzero(np.isin(h, self.shingles[i]))
            width = int(np.ceil(WIDER * self.words[i])) - SHINGLE + 1
            runs = set()
            for x in own:
                for wide, reach in enumerate((width, width + 2 * (self.words[i] // 2))):
                    near = places[np.searchsorted(places, x) : np.searchsorted(places, x + reach)]
                    # A run ends where its last new shingle comes.
                    _, first = np.unique(h[near], return_index=True)
                    if len(first) >= CONTAINMENT * len(self.shingles[i]):
                        runs.add((wide, -len(first) / len(self.shingles[i]), int(near[first.max()]) - x, x))
                        break
            taken: list[tuple[int, int]] = []
            for _, share, more, x in sorted(runs):
                a, b = int(begin[x]), int(end[x + more + SHINGLE - 1])
                # The last match that begins before b is the only one that can overlap.
                k = bisect.bisect_left(taken, (b,))
                if not k or taken[k - 1][1] <= a:
                    taken.insert(k, (a, b))
                    out.append((i, -share, a, b))
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per match: doc_id, license, template (its place in the list), containment, start and end (code points of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, share, a, b in sorted(known.scan(text or ""), key=lambda m: (m[2], m[0])):
                    raw = text.encode()
                    for col, x in zip(out, (doc_id, known.names[i], i, share, len(raw[:a].decode()), len(raw[:b].decode())), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "license", "template", "containment", "start", "end"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, license string, template int, containment double, start long, end long")
