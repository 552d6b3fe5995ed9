"""Licence texts and notices: Dice similarity of word bigrams against templates."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public notices by licence, as their licences recommend or as they are commonly written.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "BSD-3-Clause": (
        "Released under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "all-rights-reserved": ("All rights reserved.",),
}
#: Dice coefficient, in percent, from which a passage counts as a template; lines joined to one passage at most.
THRESHOLD_PERCENT, MOST_LINES = 80, 12

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_NEWLINE = re.compile(r"\n")


def bigrams(text: str) -> Counter:
    """Multiset of adjacent word pairs of the normalised text (ASCII lower case, words and version numbers only)."""
    words = _WORD.findall(text.lower())
    return Counter(zip(words, words[1:]))


class TemplateIndex:
    """Templates by size and by bigram.

    Dice ``2·|A∩B| / (|A| + |B|) >= t`` bounds the size of B to ``[t/(2-t)·|A|, (2-t)/t·|A|]`` and asks for a common bigram.
    """

    def __init__(self, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, percent: int = THRESHOLD_PERCENT):
        self.percent = percent
        self.items = [(name, b, b.total()) for name in sorted(templates) for b in map(bigrams, templates[name]) if b]
        self.by_bigram: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, (_, b, _) in enumerate(self.items):
            for pair in b:
                self.by_bigram[pair].append(i)
        self.words = frozenset(w for pair in self.by_bigram for w in pair)
        sizes = [n for _, _, n in self.items]
        self.least = -(-min(sizes) * percent // (200 - percent)) if sizes else 1
        self.most = max(sizes) * (200 - percent) // percent if sizes else 0

    def best(self, found: Counter) -> tuple[str, int] | None:
        """(licence, Dice in percent, rounded down) of the most similar template in reach; ties by name."""
        size = found.total()
        if not self.least <= size <= self.most:
            return None
        low, high = -(-size * self.percent // (200 - self.percent)), size * (200 - self.percent) // self.percent
        near = {i for pair in found for i in self.by_bigram.get(pair, ()) if low <= self.items[i][2] <= high}
        out = None
        for i in sorted(near):
            name, b, n = self.items[i]
            dice = 200 * sum(min(c, b[p]) for p, c in found.items()) // (size + n)
            if dice >= self.percent and (out is None or dice > out[1]):
                out = name, dice
        return out


def scan_text(text: str, index: TemplateIndex, most_lines: int = MOST_LINES) -> list[tuple[str, int, int, int]]:
    """(licence, Dice, start, end) of passages, from the front, none overlapping another.

    A passage is a run of whole lines.  A line opens one if its words are mostly template words; following lines join it
    while sizes stay in reach.  Among the passages that begin at a line the most similar, then the longest, is taken.
    """
    borders = [0, *(m.end() for m in _NEWLINE.finditer(text)), len(text) + 1]
    lines = len(borders) - 1
    # A passage of similarity t shares at least t/2 of its bigrams, hence most of its words, with its template.
    words: list[list[str] | None] = []
    for k in range(lines):
        own = _WORD.findall(text[borders[k]:borders[k + 1]].lower())
        words.append(own if 2 * sum(w in index.words for w in own) >= len(own) else None)
    out, i = [], 0
    while i < lines:
        best, stop, joined = None, i + 1, []
        for j in range(i, min(lines, i + most_lines) if words[i] else i):
            if words[j] is None or len(joined) + len(words[j]) - 1 > index.most:
                break
            joined = joined + words[j]
            hit = index.best(Counter(zip(joined, joined[1:]))) if words[j] else None
            if hit and (best is None or hit[1] >= best[1]):
                best, stop = hit, j + 1
        if best:
            out.append((*best, borders[i], min(borders[stop], len(text))))
        i = stop
    return out


PASSAGES = "array<struct<licence:string,dice:int,start:long,end:long>>"


def _scan(templates: Mapping[str, tuple[str, ...]], percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = TemplateIndex(templates, percent)
        for batch in batches:
            found = [[{"licence": n, "dice": d, "start": a, "end": b} for n, d, a, b in scan_text(t, index)]
                     for t in batch["_text"].tolist()]
            yield pd.DataFrame({"_id": batch["_id"], "passages": found})
    return run


def license_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    templates: Mapping[str, tuple[str, ...]] = TEMPLATES, percent: int = THRESHOLD_PERCENT,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, passages`` of (licence, dice, start, end); one pass, no shuffle.

    ``dice`` is a percentage, rounded down; places are code points, the end exclusive.  The templates travel with
    the tasks; they are a parameter, not data.  Null and empty texts have no passages; ids may be null or repeat; whole
    texts are read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = docs.select(F.col(id_col).cast("string").alias("_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    out = sent.mapInPandas(_scan(templates, percent), f"_id string, passages {PASSAGES}")
    return out.select(F.col("_id").cast(id_type).alias(id_col), "passages")
