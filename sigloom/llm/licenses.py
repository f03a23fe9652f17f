"""License scans by patience alignment.

A text's stretch is aligned with a license notice's words: the words unique to both are anchors, the
longest increasing subsequence of them is kept, and the gaps between anchors (and the runs of equal words
at the gaps' ends) are aligned again in the same way. Coverage is the share of the notice's words that
the alignment matches.

Candidate stretches are found without loss: a stretch that covers ``least`` of a notice holds that share of its
words, so a text with too few of the notice's distinct words, and a window with too few of its words, can't
match. A stretch spans at most 1 / ``least`` of the notice's length, so windows of that size are taken at each of the notice's
words in the text. Words that the alignment matches far from the rest, at a window's ends, are trimmed off.

Of stretches that overlap, of one notice or several, the one with the most words matched stays. One row per document and notice
found: the coverage and place of the best of its stretches that stay. Null and empty texts and texts
without words give no row. Null ids are carried; repeated rows repeat in the result. Other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

LEAST = 0.8
#: Notices by which a text states its license, as their publishers word them.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def words(text: str | None) -> list[str]:
    return common.PLAIN_WORD.findall(text.lower()) if text else []


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of (i, j), given in order of i, in which j increases too."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        if k == len(tops):
            tops.append(j)
            ends.append(n)
        else:
            tops[k], ends[k] = j, n
        back.append(ends[k - 1] if k else -1)
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (i, j) of a and b, both increasing: a stack of gaps takes the place of recursion, so length is no limit."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i == ie or j == je:
            continue
        in_a, in_b = Counter(a[i:ie]), Counter(b[j:je])
        place = {w: y for y, w in enumerate(b[j:je], j) if in_b[w] == 1}
        anchors = increasing([(x, place[w]) for x, w in enumerate(a[i:ie], i) if in_a[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        ends = [(i - 1, j - 1), *anchors, (ie, je)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def windows(at: np.ndarray, size: int, least: int) -> list[int]:
    """Of the places ``at``, the starts of windows of ``size`` words that hold at least ``least`` of them."""
    return at[np.searchsorted(at, at + size) - np.arange(len(at)) >= least].tolist()


def dense(matched: list[tuple[int, int]], need: int, least: float) -> list[tuple[int, int]]:
    """The longest run of the matched places, of ``need`` at least, that makes up ``least`` of the words it spans."""
    for n in range(len(matched), need - 1, -1):
        for k in range(len(matched) - n + 1):
            if n >= least * (matched[k + n - 1][0] - matched[k][0] + 1) - 1e-9:
                return matched[k : k + n]
    return []


def stretch(ws: list[str], start: int, size: int, notice: list[str], need: int, least: float) -> tuple[int, int, int] | None:
    """(words matched, first word, words) of the notice in the window, or none."""
    if ws[start : start + len(notice)] == notice:
        return len(notice), start, len(notice)
    run = dense(align(ws[start : start + size], notice), need, least)
    if not run:
        return None
    best = (len(run), start + run[0][0], run[-1][0] - run[0][0] + 1)
    # What was trimmed off may stand beside the run: there it is aligned again.
    low = max(0, best[1] - run[0][1])
    again = dense(align(ws[low : best[1] + best[2] + len(notice) - 1 - run[-1][1]], notice), need, least)
    return max(best, (len(again), low + again[0][0], again[-1][0] - again[0][0] + 1)) if len(again) > len(run) else best


def find(text: str | None, notices: list[tuple[str, list[str]]], least: float = LEAST) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, words) of the notices that the text holds."""
    ws = words(text)
    have, found = set(ws), set()
    for name, notice in notices:
        distinct = set(notice)
        need = int(np.ceil(least * len(notice) - 1e-9))
        # Of the words that may be missing, each could be another distinct one.
        if len(distinct & have) < len(distinct) - (len(notice) - need):
            continue
        at = np.flatnonzero(np.fromiter((w in distinct for w in ws), bool, len(ws)))
        size = int(len(notice) / least + 1e-9)
        for start in windows(at, size, need):
            got = stretch(ws, start, size, notice, need, least)
            if got:
                found.add((-got[0], -got[0] / len(notice), got[2], name, got[1]))
    # Stretches that stay, by place; no two of them overlap.
    taken: list[tuple[int, int]] = []
    best: dict[str, tuple] = {}
    for _, coverage, n, name, first in sorted(found):
        k = bisect_left(taken, (first, 0))
        if (k and sum(taken[k - 1]) > first) or (k < len(taken) and taken[k][0] < first + n):
            continue
        taken.insert(k, (first, n))
        best[name] = min(best.get(name, (0.0, 0, 0)), (coverage, first, n))
    return sorted((name, -coverage, first, n) for name, (coverage, first, n) in best.items())


def scan(df: DataFrame, notices: dict[str, str] | None = None, id_col: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, license, coverage, first_word, n_words) per document and notice found; places count words."""
    table = [(n, words(t)) for n, t in (NOTICES if notices is None else notices).items()]
    table = [(n, ws) for n, ws in table if ws]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for row in find(t, table, least):
                    for c, v in zip(out, (d, *row), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "license", "coverage", "first_word", "n_words"])

    rows = common.in_small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, coverage double, first_word long, n_words long")
