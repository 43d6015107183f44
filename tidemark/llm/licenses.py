"""License scan: MinHash bands over overlapping windows, then exact shingle containment.

A template of m word shingles belongs to the class c, the power of two with c/2 < m <= c. Texts are
cut into windows of 2c shingles that start every c, so each occurrence of at most c shingles lies
wholly in some window. A window that holds the share s of a template's shingles has a Jaccard
similarity with it of s m / (2c + (1 - s) m) at least. Each band is one MinHash value; a class has so
many bands that a window with the share ``CONTAINED`` shares one with chance at least ``SURE``, and one
with the whole template is found all the surer. Only those windows are verified: the share of the
template's shingles that the window holds must reach ``CONTAINED``. Shingles have five words, or all words of a shorter template.

The templates are a parameter; by default they are ``NOTICES`` and the bodies, headers, usual notices and
SPDX tags of ``license_templates.json``. Their bands are held by the tasks, behind a bound of ``TEMPLATES``.
Documents are not shuffled.

Defined results: null and empty texts give no rows, repeated rows repeat theirs, a null ``doc_id``
stays null, a template without a word is ignored, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, worker_cache
from .words import WordTable, bare, rolling

SHINGLE = 5
CONTAINED = 0.8
SURE = 0.999
TEMPLATES = 20_000
#: Documents whose shingles are one array.
SLICE = 500
#: Common license notices.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-plain": "under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "all-rights-reserved": "All rights reserved.",
}
#: Templates of the common licenses by name, besides ``NOTICES``.
TABLE = Path(__file__).with_name("license_templates.json")
FOUND = "doc_id long, license string, first_word long, last_word long, containment double"


def _describe(word: str) -> tuple:
    return (xxhash.xxh3_64_intdigest(bare(word).encode("utf-8", "surrogatepass"), 5),)


def _table() -> WordTable:
    return worker_cache("licenses", lambda: WordTable(_describe, (np.uint64,)))


def _hashes(text: str | None) -> np.ndarray:
    table = _table()
    codes = table.codes((text or "").split())
    return table.column(0)[codes]


def catalogue() -> dict[str, str]:
    """All templates of the production scan, read where the query is planned."""
    return {**json.loads(TABLE.read_text(encoding="utf-8")), **NOTICES}


class Bands:
    """Band values of the templates of one shingle length and one class."""

    def __init__(self, size: int, step: int, names: list[str], shingles: list[np.ndarray], contained: float):
        self.size, self.step, self.names, self.shingles = size, step, names, shingles
        m = min(len(s) for s in shingles)
        least = contained * m / (2 * step + (1 - contained) * m)
        count = math.ceil(math.log(1 - SURE) / math.log(1 - least))
        rng = np.random.default_rng(1000 * size + step)
        self.factors = rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.masks = rng.integers(0, 1 << 32, count, dtype=np.uint32)
        self.values, self.owners, self.low = [], [], []
        for f, m in zip(self.factors, self.masks, strict=True):
            v = np.array([self._mix(_short(s), f, m).min() for s in shingles], dtype=np.uint32)
            order = np.argsort(v)
            low = np.zeros(1 << 16, dtype=bool)
            low[v & np.uint32(0xFFFF)] = True
            self.values.append(v[order])
            self.owners.append(order)
            self.low.append(low)

    @staticmethod
    def _mix(x: np.ndarray, factor: np.uint32, mask: np.uint32) -> np.ndarray:
        return (x ^ mask) * factor

    def candidates(self, short: np.ndarray, begins: np.ndarray) -> set[tuple[int, int]]:
        """(block, template): windows of two blocks that share a band; ``begins``: of blocks."""
        found: set[tuple[int, int]] = set()
        for f, m, values, owners, low in zip(self.factors, self.masks, self.values, self.owners, self.low, strict=True):
            least = self._mix(short, f, m)
            if self.step > 1:
                least = np.minimum.reduceat(least, begins)
            least = np.minimum(least, np.r_[least[1:], least[-1]])
            at = np.flatnonzero(low[least & np.uint32(0xFFFF)])
            a, b = np.searchsorted(values, least[at], "left"), np.searchsorted(values, least[at], "right")
            for k, x, y in zip(at[b > a].tolist(), a[b > a].tolist(), b[b > a].tolist(), strict=True):
                found.update((k, int(t)) for t in owners[x:y])
        return found


def _short(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(32)).astype(np.uint32)


def templates(notices: dict[str, str], contained: float = CONTAINED) -> list[Bands]:
    """Bands of all templates, by shingle length and class."""
    if len(notices) > TEMPLATES:
        raise ValueError(f"more than {TEMPLATES} templates")
    groups: dict[tuple[int, int], tuple[list[str], list[np.ndarray]]] = {}
    for name, text in sorted(notices.items()):
        hashes = _hashes(text)
        if len(hashes):
            size = min(SHINGLE, len(hashes))
            shingles = np.unique(rolling(hashes, size))
            names, all_shingles = groups.setdefault((size, 1 << (len(shingles) - 1).bit_length()), ([], []))
            names.append(name)
            all_shingles.append(shingles)
    return [Bands(size, step, *x, contained) for (size, step), x in sorted(groups.items())]


def _scan(texts: list[str | None], bands: list[Bands], contained: float) -> list[tuple[int, str, int, int, float]]:
    """(text's place, template, first word, last word, containment) of the occurrences in some texts.

    All texts are one array of shingles; no shingle or block has words of two texts.
    """
    parts = [_hashes(x) for x in texts]
    sizes = np.array([len(p) for p in parts])
    hashes, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    found: dict[tuple[int, str], list[tuple[int, int, float]]] = {}
    made: dict[int, tuple] = {}
    for band in bands:
        n = len(hashes) - band.size + 1
        if n <= 0:
            continue
        if band.size not in made:
            whole = np.flatnonzero(owner[:n] == owner[band.size - 1 :])
            shingles = rolling(hashes, band.size)[whole]
            made[band.size] = shingles, _short(shingles), owner[whole], place[whole]
        shingles, short, of, at = made[band.size]
        if not len(shingles):
            continue
        begins = np.flatnonzero(at % band.step == 0)
        for block, t in sorted(band.candidates(short, begins)):
            begin = int(begins[block])
            end = begin + int(np.searchsorted(of[begin : begin + 2 * band.step], of[begin], "right"))
            window, own = shingles[begin:end], band.shingles[t]
            hit = np.flatnonzero(np.isin(window, own))
            share = len(np.unique(window[hit])) / len(own)
            if share >= contained:
                first = int(at[begin])
                found.setdefault((int(of[begin]), band.names[t]), []).append((first + int(hit[0]), first + int(hit[-1]) + band.size, share))
    out = []
    for (text, name), spans in sorted(found.items()):
        merged: list[tuple[int, int, float]] = []
        for a, b, share in sorted(spans):
            if merged and a < merged[-1][1]:
                a, b, share = merged[-1][0], max(b, merged[-1][1]), max(share, merged[-1][2])
                merged.pop()
            merged.append((a, b, share))
        out += [(text, name, *m) for m in merged]
    return out


def scan(docs: DataFrame, notices: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """``(doc_id, license, first_word, last_word, containment)`` of each occurrence, ends exclusive.

    Overlapping occurrences of a template are one row, with the largest containment.
    """
    bands = templates(catalogue() if notices is None else notices, contained)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(0, batch.num_rows, SLICE):
                some = batch.slice(k, SLICE)
                found = _scan(some.column(1).to_pylist(), bands, contained)
                columns = list(zip(*found, strict=True)) or [[]] * 5
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64())
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0).take(arrays[0]), *arrays[1:]], names=["doc_id", "license", "first_word", "last_word", "containment"])
            _table().trim()

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, FOUND)
