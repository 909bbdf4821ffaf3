"""License scans by patience alignment.

Words that occur once in the text and once in a template are anchors. The longest increasing run of them
is kept, and the gaps between neighbours are aligned in the same way, where other words become unique. Gaps
that are left without such a word are aligned to the most equal words. Coverage is the share of a template's
words that are aligned.

What is aligned are the stretches of a text that hold one notice each. Around each occurrence of a word that
no notice can do without, the nearest stretches with the least coverage are found exactly; of these, as many
as do not overlap are kept and extended to the most words up to their neighbours. So a notice that stands
many times is found as often. Anchors that stand in another order than the rest of a notice can cost more
words than they bring; a stretch that has more to give is then aligned as one gap.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices as their licenses word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD-2-Clause-header": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause-header": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, or "
        "(at your option) any later version."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."
    ),
    "ISC-header": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
        "License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-header": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}
LEAST_COVERAGE = 0.8
# Aligned words must lie within so many template lengths of each other: a notice is not spread over a book.
SPREAD = 2.0
WORDS = re.compile(r"\w+(?:[.-]\w+)*")
NOTICE = "license: string, coverage: double, n_aligned: bigint, first_word: bigint, last_word: bigint"
SCHEMA = (
    "doc_id bigint, license string, coverage double, n_aligned bigint, first_word bigint, last_word bigint, "
    f"notices array<struct<{NOTICE}>>"
)


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Increasing pairs (place in text, place in template) of equal words."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        if a == b or c == d:
            continue
        chain = _anchors(text, a, b, template, c, d)
        if not chain:
            pairs += [(a + i, c + j) for i, j in most_equal(text[a:b], template[c:d])]
            continue
        pairs += chain
        edges = [(a - 1, c - 1), *chain, (b, d)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(pairs)


def _anchors(text: list[int], a: int, b: int, template: list[int], c: int, d: int) -> list[tuple[int, int]]:
    """Longest increasing run of the words that are unique in both ranges."""
    once = {w for w, n in Counter(template[c:d]).items() if n == 1}
    seen = Counter(w for w in text[a:b] if w in once)
    at = {template[j]: j for j in range(c, d)}
    shared = [(i, at[text[i]]) for i in range(a, b) if seen.get(text[i]) == 1]
    tails: list[int] = []  # smallest end of a run of each length
    last: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(shared):
        length = bisect_left(tails, j)
        if length == len(tails):
            tails.append(j)
            last.append(k)
        else:
            tails[length], last[length] = j, k
        back.append(last[length - 1] if length else -1)
    chain = []
    k = last[-1] if last else -1
    while k >= 0:
        chain.append(shared[k])
        k = back[k]
    return chain[::-1]


def most_equal(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence; both sides are a stretch or a gap of one, so at most some template lengths."""
    own, other = set(text), set(template)
    rows = [i for i, w in enumerate(text) if w in other]
    columns = [j for j, w in enumerate(template) if w in own]
    if not rows:
        return []
    best = [[0] * (len(columns) + 1)]  # by words of the text left, from its end on: the most pairs by words of the template left
    for i in reversed(rows):
        below, row = best[-1], [0]
        for n, j in enumerate(reversed(columns)):
            row.append(below[n] + 1 if text[i] == template[j] else max(below[n + 1], row[n]))
        best.append(row)
    pairs = []
    a, c = len(rows), len(columns)
    while best[a][c]:
        i, j = rows[-a], columns[-c]
        if text[i] == template[j]:
            pairs.append((i, j))
            a, c = a - 1, c - 1
        elif best[a - 1][c] == best[a][c]:
            a -= 1
        else:
            c -= 1
    return pairs


class Notice(NamedTuple):
    """Words are counted from the start of the text."""

    license: str | None
    coverage: float
    n_aligned: int
    first_word: int | None
    last_word: int | None


NO_NOTICE = Notice(None, 0.0, 0, None, None)


class LicenseScanner:
    def __init__(self, templates: Mapping[str, str]):
        self.numbers: dict[str, int] = {}
        self.templates = []
        for name, text in sorted(templates.items()):
            words = WORDS.findall(text.lower())
            self.templates.append((name, [self.numbers.setdefault(w, len(self.numbers)) for w in words]))

    def scan(self, text: str) -> Notice:
        """The best of a text's notices."""
        return self.best(self.notices(text))

    def best(self, found: Sequence[Notice]) -> Notice:
        """Best covered notice, of two alike the longer template's, then the first one."""
        lengths = {name: len(template) for name, template in self.templates}
        return max(found, key=lambda n: (n.n_aligned / lengths[n.license], lengths[n.license]), default=NO_NOTICE)

    def notices(self, text: str) -> list[Notice]:
        """All notices that reach the least coverage, by template and place; those of one template do not overlap."""
        known = [(k, n) for k, w in enumerate(WORDS.findall(text.lower())) if (n := self.numbers.get(w)) is not None]
        places, numbers = [k for k, _ in known], [n for _, n in known]
        present = set(numbers)
        found = []
        for name, template in self.templates:
            if not template or sum(n in present for n in template) < LEAST_COVERAGE * len(template):
                continue  # even an alignment of all shared words would fall short
            for first, last, count in Stretches(places, numbers, template).found():
                stretch = numbers[first : last + 1]
                pairs = align(stretch, template)
                if len(pairs) < count:
                    pairs = most_equal(stretch, template)
                ends = [places[first + pairs[k][0]] for k in (0, -1)]
                found.append(Notice(name, round(len(pairs) / len(template), 6), len(pairs), *ends))
        return found


class Stretches:
    """Where the known words of a text, ``numbers`` at ``places``, hold a template."""

    def __init__(self, places: list[int], numbers: list[int], template: list[int]):
        self.places, self.numbers, self.template = places, numbers, template
        self.missed = most_missed(len(template))
        self.reach = int(SPREAD * len(template))
        own = set(template)
        self.ahead: dict[int, list[int]] = {}
        for i, n in enumerate(numbers):
            if n in own:
                self.ahead.setdefault(n, []).append(i)
        self.behind = {n: [-i for i in reversed(at)] for n, at in self.ahead.items()}
        needed = needed_words(numbers, template)
        self.anchors = [(i, j) for i, n in enumerate(numbers) if n in needed for j, m in enumerate(template) if m == n]

    def found(self) -> list[tuple[int, int, int]]:
        """(first, last, number of aligned words) of as many notices as can stand side by side."""
        spans = {
            (-before[k], after[self.missed - k])
            for i, j in self.anchors
            for before, after in [self._ends(i, j, 0, self.places[-1])]
            for k in range(self.missed + 1)
            if before[k] is not None and after[self.missed - k] is not None
        }
        cores: list[tuple[int, int]] = []
        for first, last in sorted(spans, key=lambda s: (s[1], -s[0])):
            if not cores or first > cores[-1][1]:
                cores.append((first, last))
        out = []
        for k, (first, last) in enumerate(cores):
            low = self.places[out[-1][1]] + 1 if out else 0
            high = self.places[cores[k + 1][0]] - 1 if k + 1 < len(cores) else self.places[-1]
            inside = self.anchors[bisect_left(self.anchors, (first,)) : bisect_left(self.anchors, (last + 1,))]
            out.append(max((self._widest(i, j, low, high) for i, j in inside), key=lambda s: (s[2], s[0] - s[1])))
        return out

    def _widest(self, i: int, j: int, low: int, high: int) -> tuple[int, int, int]:
        """The shortest stretch with the most aligned words around text word i as template word j."""
        before, after = self._ends(i, j, low, high)
        left = next((k for k, end in enumerate(before) if end is not None), None)
        right = next((k for k, end in enumerate(after) if end is not None), None)
        if left is None or right is None:
            return i, i, 1
        return -before[left], after[right], len(self.template) - left - right

    def _ends(self, i: int, j: int, low: int, high: int) -> tuple[list[int | None], list[int | None]]:
        """Nearest ends before (negative) and after text word i as template word j, by number of words missed."""
        low, high = max(low, self.places[i] - self.reach), min(high, self.places[i] + self.reach)
        after, before = self.template[j + 1 :], self.template[:j][::-1]
        same = alike(self.numbers[i + 1 : i + 1 + len(after)], after)
        same_before = alike(self.numbers[max(0, i - j) : i][::-1], before)
        return (
            nearest_ends(self.behind, before, -i, -bisect_left(self.places, low), self.missed, same_before),
            nearest_ends(self.ahead, after, i, bisect_right(self.places, high) - 1, self.missed, same),
        )


def alike(text: list[int], words: list[int]) -> int:
    """How many words are the same from the start on."""
    return next((k for k, (a, b) in enumerate(zip(text, words, strict=False)) if a != b), min(len(text), len(words)))


def nearest_ends(
    at: Mapping[int, list[int]], words: Sequence[int], start: int, limit: int, missed: int, same: int
) -> list[int | None]:
    """By k up to ``missed``: where ``words`` but k of them end at the earliest, taken in order after ``start``.

    The first ``same`` words follow ``start`` without a gap: all but k of them end k words before the last.
    """
    same = min(same, limit - start)
    ends: list[int | None] = [start + same - k if k <= same else None for k in range(missed + 1)]
    for word in words[same:]:
        own = at.get(word, ())
        for k in range(missed, -1, -1):
            taken = None
            if ends[k] is not None:
                n = bisect_right(own, ends[k])
                taken = own[n] if n < len(own) and own[n] <= limit else None
            left_out = ends[k - 1] if k else None
            ends[k] = left_out if taken is None else taken if left_out is None else min(taken, left_out)
    return ends


def most_missed(length: int) -> int:
    """Words a notice of a template of this length may lack."""
    return next(k for k in range(length, -1, -1) if (length - k) / length >= LEAST_COVERAGE)


def needed_words(numbers: list[int], template: list[int]) -> set[int]:
    """The text's rarest template words, enough of them that a notice aligns one at least.

    A notice may lack some of the template's places; the set has more places than that. Words the text
    lacks come first and cost nothing.
    """
    own = Counter(template)
    counts = Counter(n for n in numbers if n in own)
    lacking = most_missed(len(template))
    needed = set()
    for n in sorted(own, key=lambda n: (counts[n], n)):
        if lacking < 0:
            break
        needed.add(n)
        lacking -= own[n]
    return needed


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] | None = None, text: str = "text") -> DataFrame:
    """Best license notice of each row, and all its ``notices``: name, coverage, aligned words, first and last place.

    ``notices`` holds every notice at or above the least coverage, by template name and place, a second one of
    the same license too, and a short template's inside a longer one's. Without a notice, and for null and
    empty texts: null, 0.0, 0, null, null and an empty array.
    """
    scanner = LicenseScanner(TEMPLATES if templates is None else templates)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            notices = [scanner.notices(text or "") for text in batch["text"]]
            found = pd.DataFrame([scanner.best(n) for n in notices], columns=Notice._fields)
            found = found.astype({"first_word": "Int64", "last_word": "Int64", "license": object})
            found.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            found["notices"] = [[n._asdict() for n in own] for own in notices]
            yield found.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInPandas(scan, SCHEMA)
