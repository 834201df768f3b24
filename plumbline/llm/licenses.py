"""License scans by conditional compression.

Lines that hold a licence word, with the neighbouring lines written in the templates' words, are candidate blocks. A
long block is read in overlapping windows around its licence words, each a few times the longest template. A window is
compressed with zstandard alone and with each template as raw dictionary; the templates are ranked by how much their
dictionary shortens the window. Every template whose words the window can hold is compared word by word with the place
nearest to it, and the one with the fewest differences that still holds enough of the template's words is confirmed; the
differences are reported exactly. Its words are taken out and the words before and after them are explained in the same
way, until nothing is confirmed; of places in two windows that overlap, the one with fewer differences counts.

Defined results: NULL and empty texts have no blocks. Each confirmed notice is a row with the lines of its own words. A
block in which nothing is confirmed is one row with a NULL license and the lines of the block. Ties in size go to the template that sorts first. Rows are scanned one by one, so repeated rows agree; rows without doc_id keep it
NULL. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import strings
from .frames import id_and_text

#: Wordings of public licence notices, by name.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-3-Clause notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
    "All rights reserved": "All rights reserved.",
}
#: A line with one of these (lower case) opens a block.
CUES = ("licen", "copyright", "permission", "warrant", "rights reserved", "redistribut", "cc by", "cc0")
LEVEL = 9
#: The share of a template's words that must stand in the block in order.
COVERAGE = 0.85
#: What a missing or replaced word of the template and a word put between its words cost when its place is sought.
MISSING, INSERTED = 10, 1
#: Characters of the windows that a task remembers.
REMEMBERED = 1 << 24
_WORD = re.compile(r"(?<![\w+.-])[\w+.-]*\w")
_CUE = re.compile("|".join(map(re.escape, CUES)))


def lowered(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def words(text: str) -> list[str]:
    return _WORD.findall(lowered(text))


def nearest(template: np.ndarray, own: np.ndarray) -> tuple[int, int]:
    """The range of ``own`` that turns into ``template`` at the lowest cost; of equal ones the latest start."""
    unit, n = 1 << 32, len(own)
    inserted = np.arange(n + 1) * (INSERTED * unit)
    row = n - np.arange(n + 1)  # cost * unit + n - start
    for word in template:
        following = row + MISSING * unit
        np.minimum(following[1:], row[:-1] + np.where(own == word, 0, MISSING * unit), out=following[1:])
        row = np.minimum.accumulate(following - inserted) + inserted
    end = int(row.argmin())
    return n - int(row[end] % unit), end


class Scanner:
    """Blocks of texts and the templates that explain them; remembers blocks seen before."""

    def __init__(self, templates: Mapping[str, str]) -> None:
        import zstandard

        self.names = sorted(templates)
        self.words = [words(templates[n]) for n in self.names]
        self.vocabulary = {w: k for k, w in enumerate(sorted(set().union(*self.words)))}
        self.codes = [np.array([self.vocabulary[w] for w in own], np.int64) for own in self.words]
        self.counts = [Counter(own) for own in self.words]
        self.reach = max(map(len, self.words), default=1)
        dictionaries = [
            zstandard.ZstdCompressionDict(templates[n].encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for n in self.names
        ]
        plain = dict(level=LEVEL, write_checksum=False, write_content_size=False)
        self.alone = zstandard.ZstdCompressor(**plain)
        self.given = [zstandard.ZstdCompressor(dict_data=d, write_dict_id=False, **plain) for d in dictionaries]
        self.seen: dict[str, tuple] = {}
        self.remembered = 0

    def blocks(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(first line, last line, block): runs of lines around a cue whose words are mostly the templates'."""
        lines = text.split("\n")
        low = [line.lower() for line in lines]
        cue = [any(c in line for c in CUES) for line in low]
        if not any(cue):
            return

        def near(i: int) -> bool:
            own = words(lines[i])
            return len(own) >= 3 and sum(w in self.vocabulary for w in own) >= 0.8 * len(own)

        i = 0
        while i < len(lines):
            if not cue[i]:
                i += 1
                continue
            first = last = i
            while first > 0 and not cue[first - 1] and near(first - 1):
                first -= 1
            while last + 1 < len(lines) and (cue[last + 1] or near(last + 1)):
                last += 1
            yield first, last, "\n".join(lines[first : last + 1])
            i = last + 1

    def windows(self, low: str, starts: list[int]) -> Iterator[tuple[int, int]]:
        """Ranges of words: all of a short block, else those around the cues, so that each notice is whole in one."""
        n = len(starts)
        if n <= 5 * self.reach:
            yield 0, n
            return
        end = 0
        for cue in _CUE.finditer(low):
            at = bisect_right(starts, cue.start()) - 1
            if at >= end:
                end = at + self.reach
                yield max(0, at - 2 * self.reach), min(n, end + 2 * self.reach)

    def explain(self, block: str) -> list[tuple[int, int, str | None, int, float, float, list[str]]]:
        """(first line, last line, license, rank, reduction, coverage, differences) of each confirmed notice in the block.

        One row with license None if nothing is confirmed.
        """
        low = lowered(block)
        starts = [m.start() for m in _WORD.finditer(low)]
        taken: list[tuple] = []  # (first word, last word + 1, notice), in order and apart
        most = None
        todo = list(self.windows(low, starts))
        while todo:
            found = []
            for first, last in todo:
                text = block[starts[first] if first else 0 : starts[last] if last < len(starts) else len(block)]
                gain, notices = self.remember(text)
                most = gain if most is None else max(most, gain)
                found += [(score, first + a, first + b, notice, (first, last)) for score, a, b, notice in notices]
            found.sort(key=lambda f: (f[0], f[1], f[2]))
            again = set()
            for _, a, b, notice, window in found:
                k = bisect_right(taken, a, key=lambda t: t[0])
                if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
                    taken.insert(k, (a, b, notice))
                elif k == 0 or taken[k - 1][:2] != (a, b):
                    again.add(window)
            # Where another window's notice was better, the words beside it are explained again.
            todo = []
            for first, last in sorted(again):
                for a, b, _ in taken:
                    if first < b and a < last:
                        todo.append((first, a))
                        first = b
                todo.append((first, last))
            todo = [(a, b) for a, b in todo if a < b]
        if not taken:
            return [(0, block.count("\n"), None, 0, float(most or 0.0), 0.0, [])]
        ends = [m.start() for m in re.finditer("\n", block)]
        return [(bisect_right(ends, starts[a]), bisect_right(ends, starts[b - 1]), *notice) for a, b, notice in taken]

    def remember(self, text: str):
        known = self.seen.get(text)
        if known is None:
            self.remembered += len(text)
            if self.remembered > REMEMBERED:
                self.seen.clear()
                self.remembered = len(text)
            known = self.seen[text] = self._explain(text)
        return known

    def gains(self, text: str) -> list[float]:
        data = text.encode("utf-8", "surrogatepass")
        size = len(self.alone.compress(data))
        return [(size - len(c.compress(data))) / size for c in self.given]

    def _explain(self, text: str):
        """The largest reduction, and ((differences, -equal words), first word, last word + 1, notice) of each notice."""
        low = lowered(text)
        starts = [m.start() for m in _WORD.finditer(low)]
        own = words(low)
        whole, found, rest = self.gains(text), [], [(0, len(own))]
        while rest:
            first, last = rest.pop()
            closest = self.closest(own[first:last])
            if not closest:
                continue
            gains = whole
            if last - first < len(own):
                gains = self.gains(text[starts[first] : starts[last] if last < len(own) else len(text)])
            ranked = sorted(range(len(gains)), key=lambda k: (-gains[k], self.names[k]))
            rank, score, i, a, b, coverage, told = min((ranked.index(c[1]) + 1, *c) for c in closest)
            found.append((score, first + a, first + b, (self.names[i], rank, gains[i], coverage, told)))
            rest += [(x, y) for x, y in ((first, first + a), (first + b, last)) if x < y]
        return float(max(whole, default=0.0)), found

    def closest(self, own: list[str]) -> list[tuple]:
        """((differences, -equal words), template, first word, last word + 1, coverage, differences) of the best templates."""
        has = Counter(w for w in own if w in self.vocabulary)
        codes = np.array([self.vocabulary.get(w, -1) for w in own], np.int64)
        best: list[tuple] = []
        for i, template in enumerate(self.words):
            # Words that do not stand there at all cannot be covered.
            if sum(min(n, has[w]) for w, n in self.counts[i].items()) < COVERAGE * max(1, len(template)):
                continue
            first, last = nearest(self.codes[i], codes)
            place = own[first:last]
            steps = difflib.SequenceMatcher(None, template, place, autojunk=False).get_opcodes()
            equal = sum(b - a for tag, a, b, _, _ in steps if tag == "equal")
            coverage = equal / max(1, len(template))
            common = [k for k, step in enumerate(steps) if step[0] == "equal"]
            told, count = [], 0
            for k, (tag, a, b, c, d) in enumerate(steps):
                # Text before the first and after the last common word stands around the notice.
                around = not common or not common[0] < k < common[-1]
                if tag == "equal" or (around and a == b):
                    continue
                here, there = template[a:b], [] if around else place[c:d]
                told.append(f"{' '.join(here)} -> {' '.join(there)}")
                count += max(len(here), len(there))
            if coverage >= COVERAGE and (not best or (count, -equal) <= best[0][0]):
                confirmed = ((count, -equal), i, first + steps[common[0]][3], first + steps[common[-1]][4], coverage, told)
                best = [*(c for c in best if c[0] == confirmed[0]), confirmed]
        return best


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None) -> DataFrame:
    """(doc_id, first_line, last_line, license, rank, reduction, coverage, differences): one row per notice, or per block without one."""
    templates = dict(TEMPLATES if templates is None else templates)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                for first, _, block in scanner.blocks(text):
                    out += [(doc_id, first + a, first + b, *notice) for a, b, *notice in scanner.explain(block)]
            columns = list(zip(*out)) if out else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                names=["doc_id", "first_line", "last_line", "license", "rank", "reduction", "coverage", "differences"],
            )

    low = F.lower("text")
    rows = id_and_text(docs)
    hinted = rows.where(F.greatest(*[F.contains(low, F.lit(c)) for c in CUES]))
    schema = "doc_id long, first_line long, last_line long, license string, rank int, reduction double, coverage double, differences array<string>"
    return hinted.mapInArrow(work, schema)
