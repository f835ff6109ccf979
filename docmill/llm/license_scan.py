"""License scans by conditional compression.

A line that holds a cue word is a candidate; of a long line, the surroundings of its cues. Cues are
found in the whole text, and their words may be broken over lines and comment marks. The words around
a cue, on both sides and across lines, are a candidate block, compressed by itself and once more with
each template as zstandard's raw dictionary: what the template explains need not be written again.
Templates most of whose words the block lacks in any order can't be confirmed and are not tried. The
bytes saved rank the others. Best first they are compared with the block word by word: a match must
hold nearly all words of the template in their order with little between them. The block is cut to the
first match that is confirmed and ranked again, now without the words around it. The first confirmed there
ends the search, but for templates that save nearly as much, whose places the compressor can't
tell apart: among these the fewest missing and inserted words win, then the larger saving, then the name.
Matches of all cues are taken in the same way, largest saving first; the matched words are cut out, and
what is left is searched again until nothing confirms, so that every notice of a line is found, also
one within another.

Texts without a cue never leave the JVM. Whole texts of any length are searched for cues, and
every cue meets every template, whose number is fixed; nothing is shuffled.

Defined results: null, empty and cue-less texts have no candidates. A match stands at the line in
which it begins, in the order of the text; it needs no line of its own, and a candidate may have none.
Repeated rows are scanned each. Columns other than the id and the text are not looked at. Empty
tables give an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from typing import NamedTuple

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices as their licenses state them or as they are commonly given.
TEMPLATES = {
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License 2.0."],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Licensed under the MIT License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved."],
}
#: Identifiers, of which a line "SPDX-License-Identifier: ..." is a notice; GNU licenses also with these endings.
IDENTIFIED = [name for name in TEMPLATES if name != "proprietary"]
GNU_ENDINGS = ["-only", "-or-later"]
for _name in IDENTIFIED:
    for _ending in ["", *(GNU_ENDINGS if "GPL" in _name else [])]:
        TEMPLATES[_name].append(f"SPDX-License-Identifier: {_name}{_ending}")
#: Between the words of a cue: white space, the same for Java and Python, and the comment marks of a new line.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
GAP = rf"{SPACE}+(?:[#*/;%>|!-]+{SPACE}*)?"
CUES = rf"(?i)licen[cs]e|copyright|permission|permitted|redistribut|all{GAP}rights{GAP}reserved|public{GAP}domain|spdx"
#: The most words of a template that may be missing or inserted, as a share of its words.
MAX_MISSING, MAX_INSERTED = 0.1, 0.25
#: Bytes by which savings must differ to rank templates by themselves: a word more or less, or the code of a match.
CLOSE = 8
#: Characters on either side of a cue that belong to its block.
AROUND = 400
#: Characters between the first and the last cue whose surroundings are looked at together.
TOGETHER = 1 << 20
LEVEL = 19
MATCHES = ("array<struct<line:long,license:string,saved:double,saved_bytes:long,missing:long,inserted:long,"
           "block:string>>")
CUE = re.compile(CUES)
WORD = re.compile(r"\w+(?:[.-]\w+)*")


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


class Template(NamedTuple):
    license: str
    words: list[str]
    counts: Counter
    size: int
    press: zstandard.ZstdCompressor

    @property
    def reach(self) -> int:
        """The most words of a match."""
        return int((1 + MAX_INSERTED) * len(self.words))

    def lacks(self, held: Counter) -> bool:
        """Too many words are missing in any order."""
        return sum((self.counts - held).values()) > MAX_MISSING * len(self.words)


class Notice(NamedTuple):
    """A confirmed match: places in the text, and the number of words before it in what was looked at."""
    start: int
    stop: int
    license: str
    saved: float
    saved_bytes: int
    missing: int
    inserted: int
    before: int


class Match(NamedTuple):
    """A template confirmed by its wording, and the numbers of the words that it explains."""
    saved: int
    template: Template
    missing: int
    inserted: int
    words: tuple[int, ...]

    @property
    def wording(self) -> tuple:
        return self.missing, self.inserted, -self.saved, self.template.license, self.words


class Scanner:
    """Compressors of all templates, made once per task."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES):
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        empty = len(self.plain.compress(b""))
        self.templates = []
        for name, wordings in templates.items():
            for wording in wordings:
                raw = zstandard.ZstdCompressionDict(wording.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                size, own = len(self.plain.compress(wording.encode())) - empty, words(wording)
                self.templates.append(Template(name, own, Counter(own), size,
                                               zstandard.ZstdCompressor(level=LEVEL, dict_data=raw)))
        self.reach = max(t.reach for t in self.templates)

    def savings(self, block: str, templates: list[Template]) -> list[tuple[int, Template]]:
        """Bytes of the block that each template saves, and the template, largest saving first."""
        raw = block.encode()
        own = len(self.plain.compress(raw))
        return sorted(((own - len(t.press.compress(raw)), t) for t in templates), key=lambda s: -s[0])

    def match(self, block: str, within: int | None = None) -> tuple[str, float, int, int] | None:
        """License, share saved, missing and inserted words of the best notice of a block.

        `within` is the number of words among which the match must begin.
        """
        found = [n for n in self.notices(block) if within is None or n.before < within]
        best = min(found, key=lambda n: (n.missing, n.inserted, -n.saved, n.license), default=None)
        return best and (best.license, best.saved, best.missing, best.inserted)

    def notices(self, text: str) -> list[Notice]:
        """Every confirmed match of a text, in order."""
        out: list[Notice] = []
        for low, high, cues in surroundings(text, self.reach):
            seam = [n for n in out if n.stop > low]  # of a part that overlaps this one
            for n in self._within(text[low:high], low, cues):
                same = [o for o in seam if n.license == o.license and n.start < o.stop and o.start < n.stop]
                if all((n.missing, n.inserted) < (o.missing, o.inserted) for o in same):  # the other part cut it short
                    out = [o for o in out if o not in same] if same else out
                    out.append(n)
        return sorted(out)

    def _within(self, part: str, low: int, cues: list[int]) -> list[Notice]:
        found = list(WORD.finditer(part))
        own, starts = [m.group().lower() for m in found], [m.start() for m in found]
        kept, left = [], list(range(len(own)))
        marked = {max(0, bisect_right(starts, c - low) - 1) for c in cues}
        while fresh := self._confirmed(part, found, own, left, marked):
            taken = winners(fresh)
            gone = {i for m in taken for i in m.words}
            kept += taken
            left = [i for i in left if i not in gone]
            marked -= gone
        claimed = {i for m in kept for i in m.words}
        return [Notice(low + found[m.words[0]].start(), low + found[m.words[-1]].end(), m.template.license,
                       m.saved / m.template.size, m.saved, m.missing,
                       sum(i not in claimed for i in range(m.words[0], m.words[-1])), m.words[0]) for m in kept]

    def _confirmed(self, part: str, found: list[re.Match], own: list[str], left: list[int], marked: set[int]) -> list[Match]:
        """At every cue the template that saves most of those confirmed by wording, and those that save nearly as much."""
        now = [own[i] for i in left]
        held, out = Counter(now), {}
        at = [k for k, i in enumerate(left) if i in marked]
        possible = [t for t in self.templates if not t.lacks(held)] if at else []
        for k in at if possible else ():
            near = [t for t in possible if not t.lacks(Counter(now[max(0, k - t.reach):k + 1 + t.reach]))]
            if not near:
                continue
            reach = max(t.reach for t in near)

            def confirmed(template: Template, saved: int, k: int = k) -> Match | None:
                begin = max(0, k - template.reach)
                missing, inserted, same = differences(template.words, now[begin:k + 1 + template.reach])
                if same:  # the block may end within the notice
                    begin, end = max(0, begin + same[0] - template.reach), begin + same[-1] + 1 + template.reach
                    missing, inserted, same = differences(template.words, now[begin:end])
                if missing > MAX_MISSING * len(template.words) or inserted > MAX_INSERTED * len(template.words):
                    return None
                return Match(saved, template, missing, inserted, tuple(left[begin + i] for i in same))

            ranked = self.savings(joined(part, found, left[max(0, k - reach):k + 1 + reach]), near)
            best = next(filter(None, (confirmed(t, saved) for saved, t in ranked)), None)
            if best is None:
                continue
            # once more for the block cut to the match: other words around it no longer count
            inner = left[bisect_left(left, best.words[0]):bisect_right(left, best.words[-1])]
            least = None
            for saved, template in self.savings(joined(part, found, inner), near):
                if least is not None and saved < least:
                    break
                match = confirmed(template, saved)
                if match and match.words[0] <= best.words[-1] and best.words[0] <= match.words[-1]:
                    least = saved - CLOSE if least is None else least
                    name = template.license, tuple(template.words), match.words
                    out[name] = max(match, out.get(name, match), key=lambda m: m.saved)
        return list(out.values())


def joined(part: str, found: list[re.Match], numbers: list[int]) -> str:
    """The text of the numbered words; what lies between them is left out where words are gone."""
    return " ".join(part[found[low].start():found[high].end()] for low, high in stretches(numbers))


def stretches(numbers: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of every stretch of consecutive numbers."""
    start = 0
    for i in range(1, len(numbers) + 1):
        if i == len(numbers) or numbers[i] != numbers[i - 1] + 1:
            yield numbers[start], numbers[i - 1]
            start = i


def winners(matches: list[Match]) -> list[Match]:
    """Matches without a common word: the largest saving first, or of those that share words with it and save
    nearly as much, the one with the best wording."""
    ranked = sorted(matches, key=lambda m: (-m.saved, m.wording))
    holders: dict[int, list[int]] = {}
    for n, m in enumerate(ranked):
        for i in m.words:
            holders.setdefault(i, []).append(n)
    gone: set[int] = set()
    out = []
    for lead in ranked:
        if not gone.isdisjoint(lead.words):
            continue
        rivals = (ranked[n] for n in sorted({n for i in lead.words for n in holders[i]}))
        best = min((m for m in rivals if m.saved >= lead.saved - CLOSE and gone.isdisjoint(m.words)),
                   key=lambda m: m.wording)
        out.append(best)
        gone.update(best.words)
    return out


def differences(template: list[str], block: list[str]) -> tuple[int, int, list[int]]:
    """Words of the template that the block lacks, words between the matching ones, and the places of these in the block.

    The longest common run is the anchor; words further from it than the template is long do not count.
    """
    anchor = SequenceMatcher(None, block, template, autojunk=False).find_longest_match()
    low = max(0, anchor.a - len(template))
    near = block[low:anchor.a + anchor.size + len(template)]
    same = [low + i for m in SequenceMatcher(None, near, template, autojunk=False).get_matching_blocks()
            for i in range(m.a, m.a + m.size)]
    return len(template) - len(same), (same[-1] + 1 - same[0] - len(same)) if same else 0, same


def surroundings(text: str, reach: int) -> Iterator[tuple[int, int, list[int]]]:
    """Parts of a text, as start and end, with the places of their cues; more than `reach` words on both sides of each cue."""
    def far(at: int, sign: int) -> int:
        size = AROUND
        while True:
            low, high = (max(0, at - size), at) if sign < 0 else (at, min(len(text), at + size))
            end = low if sign < 0 else high
            if end in (0, len(text)) or len(WORD.findall(text[low:high])) > reach + 1:  # the last may be part of a word
                return end
            size *= 2

    part = None
    for cue in CUE.finditer(text):
        low, high = far(cue.start(), -1), far(cue.end(), 1)
        if part and low <= part[1] and cue.start() - part[2][0] < TOGETHER:
            part[2].append(cue.start())
            part = part[0], max(part[1], high), part[2]
        else:
            if part:
                yield part
            part = low, high, [cue.start()]
    if part:
        yield part


def blocks(text: str) -> list[tuple[int, int, int]]:
    """Line number, start and end of every candidate: a line that holds a cue, or of a long line the surroundings of cues."""
    out: list[tuple[int, int, int]] = []
    line = counted = 0
    for cue in CUE.finditer(text):
        low = max(0, cue.start() - AROUND)
        start = max(low, text.rfind("\n", low, cue.start()) + 1)
        stop = text.find("\n", cue.end(), cue.end() + AROUND)
        stop = min(len(text), cue.end() + AROUND) if stop < 0 else stop
        if out and start <= out[-1][2]:
            out[-1] = out[-1][0], out[-1][1], max(stop, out[-1][2])
        else:
            line += text.count("\n", counted, start)
            counted = start
            out.append((line, start, stop))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_candidates, matches (array of line, license, saved, saved_bytes, missing, inserted, block): a row per row of `docs`.

    A match's block is its text, from its first word to its last; words of another notice within it are not inserted
    ones. `saved_bytes` is what its template saved of the block cut to a match, `saved` that as a share of the template's own
    compressed size.
    """
    @F.pandas_udf(f"n_candidates long, matches {MATCHES}")
    def of(texts: pd.Series) -> pd.DataFrame:
        scanner = Scanner()
        counts, found = [], []
        for text in texts:
            counts.append(len(blocks(text)) if text else 0)
            matches, line, counted = [], 0, 0
            for n in scanner.notices(text) if counts[-1] else ():
                line += text.count("\n", counted, n.start)
                counted = n.start
                matches.append({"line": line, "license": n.license, "saved": n.saved, "saved_bytes": n.saved_bytes,
                                "missing": n.missing, "inserted": n.inserted, "block": text[n.start:n.stop]})
            found.append(matches)
        return pd.DataFrame({"n_candidates": counts, "matches": found})
    held = F.when(F.col("text").rlike(CUES), F.col("text"))
    return docs.select("doc_id", of(held).alias("found")).select("doc_id", "found.*")
