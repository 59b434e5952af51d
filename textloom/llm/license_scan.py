"""License scan: windows of each document retrieve license templates by MinHash bands, exact containment confirms them.

A template of n words is sought with windows of the next power of two of words, which start every quarter of a window.
Such a window shares at least 0.4 of its word pairs with a template that it holds to ``CONTAINED``; with 32 bands of
two minima the chance that none agrees is then below 0.004, and below 1e-5 for a whole copy of a notice of 5 words.
A confirmed match holds at least ``CONTAINED`` hundredths of the template's word pairs within the window and half a
window on either side. Only templates are broadcast, in blocks of bounded size with one pass over the documents each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import textbytes as tb

BANDS, ROWS = 32, 2
CONTAINED = 85
LEAST_WINDOW = 8
#: Bytes of templates in one broadcast.
BLOCK_BYTES = 8_000_000

_RNG = np.random.default_rng(20241103)
_A = _RNG.integers(1, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32)
_SIEVE_BITS = 16

# Wording of common license notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def word_pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring words of lowered bytes (those over a row's end too), and each row's first word."""
    starts, ends, first = tb.words(data, offsets, tb.ALNUM)
    return tb.windows(tb.identity(data, starts, ends), 2), first


def _lowest(pairs: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    y = pairs.astype(np.uint32) * _A[k]
    y += _B[k]
    return np.minimum.reduceat(np.append(y, np.uint32(0)), bounds)[::2]


def _band(low: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (low.astype(np.uint64) << np.uint64(32)) | other


def _sieved(key: np.ndarray) -> np.ndarray:
    return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SIEVE_BITS)


class Templates:
    """Word-pair sets of the templates by window size, and their bands."""

    def __init__(self, templates: list[tuple[str, str]]) -> None:
        self.sets: list[tuple[str, np.ndarray]] = []
        self.bands: dict[int, list[dict[int, list[int]]]] = {}
        for name, text in templates:
            data = tb.LOWER[np.frombuffer(text.encode(), np.uint8)]
            pairs, first = word_pairs(data, np.array([0, len(data)]))
            if not len(pairs):
                raise ValueError(f"a template of {name} has fewer than two words")
            window = LEAST_WINDOW
            while window < first[-1]:
                window *= 2
            at = self.bands.setdefault(window, [defaultdict(list) for _ in range(BANDS)])
            bounds = np.array([0, len(pairs)])
            for b in range(BANDS):
                at[b][int(_band(_lowest(pairs, bounds, 2 * b), _lowest(pairs, bounds, 2 * b + 1))[0])].append(len(self.sets))
            self.sets.append((name, np.unique(pairs)))
        self.sieves = {}
        for window, bands in self.bands.items():
            self.bands[window] = [dict(b) for b in bands]
            self.sieves[window] = np.zeros((BANDS, 1 << _SIEVE_BITS), bool)
            for b, keys in enumerate(bands):
                self.sieves[window][b, _sieved(np.array(list(keys), np.uint64))] = True

    def candidates(self, pairs: np.ndarray, first: np.ndarray) -> set[tuple[int, int, int, int]]:
        """(row, window start, window size, template) for windows that share a band with a template."""
        out = set()
        for window, bands in self.bands.items():
            n = np.maximum(first[1:] - first[:-1] - 1, 0)  # pairs in each row
            step = window // 4
            grid = np.where(n > 0, (np.maximum(n - 1, 0)) // step + 1, 0)
            row = np.repeat(np.arange(len(n)), grid)
            if not len(row):
                continue
            start = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(grid) - grid, grid)) * step
            stop = np.minimum(start + window - 1, first[row] + n[row])
            bounds = np.stack([start, stop], axis=1).ravel()
            for b in range(BANDS):
                key = _band(_lowest(pairs, bounds, 2 * b), _lowest(pairs, bounds, 2 * b + 1))
                for k in np.flatnonzero(self.sieves[window][b, _sieved(key)]).tolist():
                    for t in bands[b].get(int(key[k]), ()):
                        out.add((int(row[k]), int(start[k]), window, t))
        return out

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, str, int, int, float]]:
        """(row, license, first word, words, containment) of the best place of each template in each text."""
        for at, data, offsets in tb.chunks(texts):
            pairs, first = word_pairs(tb.LOWER[data], offsets)
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            for row, start, window, t in self.candidates(pairs, first):
                low = max(int(first[row]), start - window // 2)
                high = min(int(first[row + 1]) - 1, start + window - 1 + window // 2)
                wanted = self.sets[t][1]
                share = np.isin(wanted, pairs[low:high]).sum()
                if 100 * share >= CONTAINED * len(wanted):
                    inside = np.flatnonzero(np.isin(pairs[low:high], wanted))
                    place = low + int(inside[0]) - int(first[row])
                    size = int(inside[-1] - inside[0]) + 2
                    best[row, t] = max(best.get((row, t), (0.0, 0, 0)), (share / len(wanted), -place, size))
            for (row, t), (share, place, size) in best.items():
                yield at + row, self.sets[t][0], -place, size, share


def _matches(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted(shared.value.scan(batch.column("text")))
            rows, names, places, sizes, shares = zip(*found, strict=True) if found else ((),) * 5
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shares, pa.float64())], ["doc_id", "license", "first_word", "n_words", "containment"])

    return run


def blocks(templates: list[tuple[str, str]], most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    part, size = [], 0
    for t in templates:
        n = len(t[1].encode())
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += n
    if part:
        yield part


def license_matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, license, first_word, n_words, containment)``: a row for each template
    that a text holds, at its best place. Null or empty texts hold none; rows may repeat; other columns are ignored.
    """
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for part in blocks(TEMPLATES if templates is None else templates):
        shared = spark.sparkContext.broadcast(Templates(part))
        parts.append(docs.mapInArrow(_matches(shared), "doc_id long, license string, first_word long, n_words long, containment double"))
    if not parts:
        return spark.createDataFrame([], "doc_id long, license string, first_word long, n_words long, containment double")
    return reduce(DataFrame.unionByName, parts)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and license: places found, first word of the first, best containment in millionths."""
    found = license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.groupBy("doc_id", "license").agg(F.count("*").alias("n_templates"), F.min("first_word").alias("first_word"), F.round(F.max("containment") * 1_000_000).cast("long").alias("containment_ppm"))


QUERIES = {"op1_license_scan": op1_license_scan}
#: Containment around every window isn't for SQL; tests compare with brute force over all windows.
ORACLES: dict[str, str] = {}
