"""License texts inside documents (op2).

Templates are normalised (A-Z lower-cased, words joined by one blank) and hashed by overlapping stretches of
``GRAM`` bytes; from every ``WINDOW`` neighbouring hashes the smallest is kept (winnowing). The kept hashes form an
inverted index from fingerprint to (template, position). A document's stretches are looked up in the index, so any
passage that shares a kept stretch with a template makes the pair a candidate, with the diagonals on which
they meet. For each candidate the words of the region are aligned with the template's in a band of ``band`` words
around the diagonal (match 2, mismatch -1, gap -1), and the alignment gives coverage and the span. Overlapping
findings of one template are reported once, the best first; so a template found twice gives two rows.

Everything about a document happens in the task that reads it: one narrow pass, no shuffle. Templates are a
parameter of at most ``MAX_TEMPLATE_BYTES``, so the index that goes to the tasks is bounded.

Rows: null and empty texts have no finding and give no row. Long texts are hashed whole, in memory proportional to
the one text. Repeated rows are reported each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 12
WINDOW = 6
BAND = 8
LEAST_COVERAGE = 0.8
MAX_TEMPLATE_BYTES = 4_000_000

# License notices, fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
BASE = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str) -> tuple[bytes, list[bytes], list[tuple[int, int]]]:
    """(joined words, words, byte places of the words in the text)."""
    data = text.encode()
    words = data.lower().split()
    places, at = [], 0
    low = data.lower()
    for w in words:
        at = low.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    return b" ".join(words), words, places


def gram_hashes(data: bytes) -> np.ndarray:
    """Hash of every stretch of GRAM bytes: a polynomial over 64-bit words, made by doubling."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    if len(x) < GRAM:
        return np.zeros(0, np.uint64)
    n = len(x) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for i in range(GRAM):
        out = out * BASE + x[i : i + n]
    return out ^ (out >> np.uint64(29))


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Positions of the smallest hash (rightmost on a tie) of every window."""
    if len(hashes) == 0:
        return np.zeros(0, np.int64)
    if len(hashes) <= WINDOW:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))])
    windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(windows)) + WINDOW - 1 - windows.argmin(axis=1))


class Index:
    """Inverted index over winnowed template fingerprints."""

    def __init__(self, templates: dict[str, str]) -> None:
        if sum(len(t.encode()) for t in templates.values()) > MAX_TEMPLATE_BYTES:
            raise ValueError("the templates pass the documented bound")
        self.words: dict[str, list[bytes]] = {}
        self.posts: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for name, text in templates.items():
            joined, words, _ = normalised(text)
            self.words[name] = words
            starts = word_starts(words)
            hashes = gram_hashes(joined)
            for p in winnow(hashes).tolist():
                word = int(np.searchsorted(starts, p, "right")) - 1
                self.posts[int(hashes[p])].append((name, word))
        self.keys = np.array(sorted(self.posts), np.uint64)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of hashes that the index holds."""
        near = np.flatnonzero(self.sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if len(near) == 0 or len(self.keys) == 0:
            return near[:0]
        at = np.minimum(np.searchsorted(self.keys, hashes[near]), len(self.keys) - 1)
        return near[self.keys[at] == hashes[near]]


def word_starts(words: list[bytes]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))[:-1].astype(np.int64)


def align(template: list[bytes], words: list[bytes], first: int, band: int) -> tuple[int, int, int, int]:
    """(score, matched words, first word, word after the last) of the best banded local alignment.

    Template word i meets document words first + i - band .. first + i + band.
    """
    width = 2 * band + 1
    score = np.zeros(width, np.int64)
    matched = np.zeros(width, np.int64)
    begin = np.full(width, -1, np.int64)
    best = (0, 0, 0, 0)
    for i, t in enumerate(template):
        new, new_matched, new_begin = np.zeros(width, np.int64), np.zeros(width, np.int64), np.full(width, -1, np.int64)
        for k in range(width):
            j = first + i + k - band
            if not 0 <= j < len(words):
                continue
            same = words[j] == t
            # Diagonal: same place of the band. Up (template word skipped): one place right. Left: one place left.
            options = [(0, 0, -1)]
            options.append((score[k] + (2 if same else -1), matched[k] + same, begin[k] if begin[k] >= 0 else j))
            if k + 1 < width:
                options.append((score[k + 1] - 1, matched[k + 1], begin[k + 1]))
            if k:
                options.append((new[k - 1] - 1, new_matched[k - 1], new_begin[k - 1]))
            s, m, b = max(options, key=lambda o: (o[0], o[1]))
            if s > 0:
                new[k], new_matched[k], new_begin[k] = s, m, b
                if (s, m) > best[:2]:
                    best = (int(s), int(m), int(b), j + 1)
        score, matched, begin = new, new_matched, new_begin
    return best


def findings(text: str, index: Index, band: int = BAND, least: float = LEAST_COVERAGE) -> list[tuple[str, float, int, int]]:
    """(template, coverage, start, end) with byte places of the original text."""
    hashes = gram_hashes(b" ".join(text.encode().lower().split()))
    hits = index.found(hashes)
    if len(hits) == 0:
        return []
    _, words, places = normalised(text)
    starts = word_starts(words)
    # Diagonals per template, at the grain of half a band.
    diagonals: dict[str, set[int]] = defaultdict(set)
    for p, w in zip(hits.tolist(), (np.searchsorted(starts, hits, "right") - 1).tolist()):
        for name, word in index.posts[int(hashes[p])]:
            diagonals[name].add(w - word)
    out = []
    for name, firsts in diagonals.items():
        template = index.words[name]
        tried = []
        last = None
        for first in sorted(firsts):
            if last is not None and first - last <= band // 2:
                continue
            last = first
            score, matched, a, b = align(template, words, first, band)
            if matched >= least * len(template):
                tried.append((matched / len(template), score, a, b))
        taken: list[tuple[int, int]] = []
        for coverage, _, a, b in sorted(tried, key=lambda x: (-x[0], -x[1], x[2])):
            if all(b <= c or a >= d for c, d in taken):
                taken.append((a, b))
                out.append((name, coverage, places[a][0], places[b - 1][1]))
    return sorted(out, key=lambda x: (x[2], x[0]))


def scan(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, band: int = BAND, least: float = LEAST_COVERAGE,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, template, coverage, start, end): one row a finding, places in bytes of the UTF-8 text."""
    index = Index(templates)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (d, *f)
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for f in findings(t or "", index, band, least)
            ]
            cols = list(zip(*rows)) if rows else [[], [], [], [], []]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "template", "coverage", "start", "end"]
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        work, "doc_id long, template string, coverage double, start long, end long"
    )
