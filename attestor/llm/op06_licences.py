"""Licence scans by patience alignment of texts with notice templates.

Words that stand once in both the text and the template are anchors; the longest increasing subsequence of their places
is kept, common words next to anchors are added, and the gaps between anchors are aligned in the same way. Coverage is
the share of the template's words that are aligned; LEAST of them make a hit.

A long text is not aligned as a whole: a hit of coverage c holds a share c of the template's distinct words within a
window of STRETCH times the template's length, so only such windows are aligned, each of them. Texts without any of the
words of which a hit needs one at least are passed over (if all of the longest floor((1 - LEAST) d) + 1 of the d
distinct words miss, coverage falls below LEAST). Of overlapping hits the one of higher coverage stays, then the
longer, then the first by name.

Defined cases: a null or blank text has no hit; rows with a null doc_id and repeated rows give one row each; further
columns are ignored; an empty table gives an empty result; an empty list of templates gives rows without hits.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from attestor.llm.common import map_rows, table, texts

LEAST, STRETCH = 0.8, 1.5
SCHEMA = "doc_id long, n_hits long, licence string, coverage double, spans string"
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")

#: Notice texts of common licences.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-line": "Released under the MIT License",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved",
}


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-case words of a text and their places (code points)."""
    low = text.lower()
    if len(low) != len(text):  # some capitals have longer lower-case forms
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = list(_WORD.finditer(low))
    return [m[0] for m in found], [m.span() for m in found]


def longest_increasing(places: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        if k == len(tops):
            tops.append(p)
            at.append(i)
        else:
            tops[k], at[k] = p, i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (i, j) with a[i] == b[j], increasing in both: patience alignment."""
    pairs, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        i0, i1, j0, j1 = open_.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            pairs.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            pairs.append((i1, j1))
        if i0 >= i1 or j0 >= j1:
            continue
        times_a, times_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        place = {w: j for j, w in enumerate(b[j0:j1], j0) if times_b[w] == 1}
        anchors = [(i, place[a[i]]) for i in range(i0, i1) if times_a[a[i]] == 1 and a[i] in place]
        if not anchors:
            continue
        chosen = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        pairs += chosen
        for (i, j), (k, m) in zip([(i0 - 1, j0 - 1), *chosen], [*chosen, (i1, j1)], strict=True):
            if i + 1 < k and j + 1 < m:
                open_.append((i + 1, k, j + 1, m))
    return sorted(pairs)


class Scanner:
    """Templates made ready: words, distinct words, and the words of which a hit needs one."""

    def __init__(self, templates: dict[str, str], least: float = LEAST, stretch: float = STRETCH):
        self.least, self.stretch = least, stretch
        self.templates = []
        for name, text in sorted(templates.items()):
            own, _ = words_of(text)
            # every template word counts, so a word that misses costs at least one of len(own)
            missing = int((1 - least) * len(own) + 1e-9)
            distinct = sorted(set(own), key=lambda w: (-len(w), w))
            self.templates.append((name, own, set(own), distinct[: missing + 1], missing))

    def hits(self, text: str) -> list[tuple[str, float, int, int]]:
        """(name, coverage, start, end in code points) of every hit, by start."""
        low = text.lower()
        possible = [t for t in self.templates if any(w in low for w in t[3])]
        if not possible:
            return []
        words, places = words_of(text)
        found = []
        for name, own, distinct, _, missing in possible:
            at = [i for i, w in enumerate(words) if w in distinct]
            if len({words[i] for i in at}) < len(distinct) - missing:
                continue
            width = int(self.stretch * len(own)) + 2
            found += self._windows(name, own, distinct, missing, words, places, at, width)
        found.sort(key=lambda h: (-h[1], h[2] - h[3], h[0], h[2]))
        starts: list[int] = []
        kept: list[tuple[str, float, int, int]] = []  # by start, without overlaps: only the neighbours can overlap another
        for h in found:
            i = bisect_left(starts, h[2])
            if (i == 0 or kept[i - 1][3] <= h[2]) and (i == len(kept) or h[3] <= kept[i][2]):
                starts.insert(i, h[2])
                kept.insert(i, h)
        return kept

    def _windows(self, name, own, distinct, missing, words, places, at, width):
        """Align each window of matching words that holds enough of the template's distinct words."""
        out, inside, left, past = [], Counter(), 0, -1
        need = max(1, len(distinct) - missing)
        best = None
        for right, i in enumerate(at):
            inside[words[i]] += 1
            while at[left] <= i - width:
                inside[words[at[left]]] -= 1
                if not inside[words[at[left]]]:
                    del inside[words[at[left]]]
                left += 1
            if len(inside) >= need and at[left] > past:
                pairs = align(own, words[at[left] : i + 1])
                coverage = len(pairs) / len(own)
                if coverage >= self.least:
                    first, last = at[left] + pairs[0][1], at[left] + pairs[-1][1]
                    if best is None or coverage > best[0]:
                        best = (coverage, first, last)
            if best is not None and (right + 1 == len(at) or at[right + 1] > best[1] + width or best[0] == 1.0):
                out.append((name, best[0], places[best[1]][0], places[best[2]][1]))
                past, best = best[2], None
                while left <= right and at[left] <= past:
                    inside[words[at[left]]] -= 1
                    if not inside[words[at[left]]]:
                        del inside[words[at[left]]]
                    left += 1
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """The hits of every document; licence and coverage are those of its best hit."""
    chosen = TEMPLATES if templates is None else templates

    def make():
        scanner = Scanner(chosen, least)

        def each(batch):
            rows = []
            for text in texts(batch):
                hits = scanner.hits(text)
                best = max(hits, key=lambda h: (h[1], h[3] - h[2]), default=None)
                rows.append((len(hits), best and best[0], best and round(best[1], 6), ",".join(f"{n}:{a}:{b}" for n, _, a, b in hits)))
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.string())
            return pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [f.split()[0] for f in SCHEMA.split(", ")])

        return each

    return map_rows(docs, {"doc_id": "doc_id", "text": "text"}, make, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
