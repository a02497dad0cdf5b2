"""License scan by patience alignment.

A text is compared with license templates word by word. Words that occur once in the text's stretch
and once in the template's are anchors; the longest increasing run of anchors is fixed, and the
gaps between fixed anchors are aligned in the same way until no gap has an anchor left. Words at
both ends of a gap that agree are aligned directly. Coverage is the share of the template's words
that are aligned.

A long text isn't aligned as a whole: the words that it shares with a template are found first, and
each dense stretch of them is aligned on its own, so repeated notices don't hide each other's
anchors. A stretch that shares too few words to reach the wanted coverage is passed over; that bound
is exact, because only shared words can be aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")

#: Wording of common license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "All-rights-reserved": "All rights reserved.",
}

Pair = tuple[int, int]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def longest_increasing(pairs: list[Pair]) -> list[Pair]:
    """The longest run of pairs, sorted by their first part, whose second parts increase; piles as in patience sorting."""
    tops: list[int] = []
    pile: list[int] = []
    before: list[int] = []
    for number, (_, second) in enumerate(pairs):
        at = bisect_left(tops, second)
        before.append(pile[at - 1] if at else -1)
        if at == len(tops):
            tops.append(second)
            pile.append(number)
        else:
            tops[at], pile[at] = second, number
    out, number = [], pile[-1] if pile else -1
    while number >= 0:
        out.append(pairs[number])
        number = before[number]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[Pair]:
    """Aligned positions of two word lists."""
    out: list[Pair] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        count_a, count_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[j]: j for j in range(b0, b1) if count_b[b[j]] == 1}
        anchors = longest_increasing([(i, at[a[i]]) for i in range(a0, a1) if count_a[a[i]] == 1 and a[i] in at])
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            gaps.append((i + 1, k, j + 1, m))
    return sorted(out)


class LicenseMatcher:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.templates = {name: words_of(text) for name, text in templates.items()}
        self.counts = {name: Counter(words) for name, words in self.templates.items()}
        self.coverage = coverage
        self.by_word: dict[str, list[str]] = {}
        for name, words in self.templates.items():
            for word in set(words):
                self.by_word.setdefault(word, []).append(name)

    def stretches(self, places: list[int], length: int) -> Iterator[tuple[int, int]]:
        """Runs of places with gaps up to twice the template's length, cut into windows of two and a half lengths, one at each half.

        So every stretch of up to twice the length lies whole in some window.
        """
        step = max(1, length // 2)
        window = 2 * length + step
        begin = 0
        for k in range(1, len(places) + 1):
            if k == len(places) or places[k] - places[k - 1] > 2 * length:
                first, last = places[begin], places[k - 1] + 1
                for at in range(first, max(first + 1, last - window + step), step):
                    yield at, min(last, at + window)
                begin = k

    def find(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, last word + 1) of every separate stretch that reaches the coverage, best first for each template."""
        words = words_of(text)
        places: dict[str, list[int]] = {}
        for at, word in enumerate(words):
            for name in self.by_word.get(word, ()):
                places.setdefault(name, []).append(at)
        out = []
        for name, own in places.items():
            template = self.templates[name]
            least = self.coverage * len(template)
            if sum((Counter(words[i] for i in own) & self.counts[name]).values()) < least:
                continue
            found = []
            pieces = list(self.stretches(own, len(template)))
            while pieces:
                begin, end = pieces.pop()
                part = words[begin:end]
                if sum((Counter(part) & self.counts[name]).values()) < least:
                    continue
                pairs = align(part, template)
                if len(pairs) >= least:
                    first, last = begin + pairs[0][0], begin + pairs[-1][0] + 1
                    found.append((name, len(pairs) / len(template), first, last))
                    pieces += [(begin, first), (last, end)]  # another notice may stand next to it
            taken: list[tuple[int, int]] = []
            for match in sorted(found, key=lambda m: (-m[1], m[3] - m[2], m[2])):
                if all(match[3] <= b or match[2] >= e for b, e in taken):
                    taken.append(match[2:])
                    out.append(match)
        return sorted(out, key=lambda m: (m[2], m[0], m[3]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, license, coverage, first_word, end_word``: one row for each stretch of a text that covers a template.

    Words are letters and digits, lower-cased; positions count them. Null and empty texts and texts
    without a notice give no rows; repeated rows repeat theirs; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = LicenseMatcher(templates, coverage)
        for batch in batches:
            rows = [(row, *match) for row, text in enumerate(batch.column(1)) for match in matcher.find(text.as_py() or "")]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()),
                pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())], [id_col, "license", "coverage", "first_word", "end_word"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {kind}, license string, coverage double, first_word long, end_word long")
