"""License scans: exact notices, changed wording, look-alikes, odd rows."""

import random

import pytest

from docmill.llm import license_scan as S
from docmill.llm.queries import QUERIES


@pytest.fixture(scope="module")
def scanner():
    return S.Scanner()


ALL = [(name, wording) for name, own in S.TEMPLATES.items() for wording in own]
SHORT = [(name, wording) for name, wording in ALL if len(wording) < S.AROUND]


def candidates(text):
    """Line number, block, and the block with the lines after it, for every candidate."""
    out = []
    for line, start, stop in S.blocks(text):
        longer = stop
        while longer < len(text) and text[longer] == "\n" and longer - start < 2 * S.AROUND:
            behind = text.find("\n", longer + 1)
            longer = len(text) if behind < 0 else behind
        out.append((line, text[start:stop], text[start:longer]))
    return out


@pytest.mark.parametrize("name,wording", SHORT)
def test_every_template_finds_itself(scanner, name, wording):
    assert [c[:2] for c in candidates(f"before\n{wording}\nafter")] == [(1, wording)]
    found = scanner.match(wording)
    assert found[0] == name and found[2:] == (0, 0)
    within = scanner.match(f"Some words stand before it. {wording} And some behind it.")
    assert (within[0], *within[2:]) == (name, 0, 0)
    assert scanner.match(f"(c) 2024 {wording}")[0] == name


@pytest.mark.parametrize("block", [
    "You need a driving license for this.", "copyright", "No permission was given to the licensee of the pub.",
    "license " * 500, "Licensed", "All rights are wrong, all lefts reserved public licence"])
def test_other_uses_of_the_words_are_no_match(scanner, block):
    assert candidates(block) and scanner.match(block) is None


@pytest.mark.parametrize("name,wording", SHORT)
def test_notices_in_long_lines_and_broken_into_lines(spark, name, wording):
    filler = "Plain words of a text that goes on for a while and says nothing of the kind. "
    own = wording.split()
    broken = "\n".join(" ".join(own[i:i + 6]) for i in range(0, len(own), 6))
    for text, line in ((filler * 40 + wording + " " + filler * 40, 0), (f"{filler}\n{broken}\n{filler}", None)):
        scanner = S.Scanner()
        found = [(i, scanner.match(b) or scanner.match(more, len(S.words(b)))) for i, b, more in candidates(text)]
        hits = [(i, h) for i, h in found if h]
        if line == 0:
            assert any(h[0] == name and h[2] == 0 and i == 0 for i, h in hits), found
        elif S.CUE.search(broken.split("\n")[0]):  # found where the cue is in its first line
            assert any(h[0] == name and h[2] == 0 for _, h in hits), found


def test_a_block_does_not_take_the_notice_of_the_next_line(scanner):
    text = "No license is meant by this line.\n" + S.TEMPLATES["MIT"][0]
    (_, first, longer), (i, second, _) = candidates(text)
    assert scanner.match(first) is None and scanner.match(longer, len(S.words(first))) is None
    assert i == 1 and scanner.match(second)[0] == "MIT"


def test_versions_are_told_apart(scanner):
    three = "This work is licensed under the GNU General Public License, version 3."
    assert scanner.match(three)[0] == "GPL-3.0"
    assert scanner.match(three.replace("3.", "2."))[0] == "GPL-2.0"
    assert scanner.match(three.replace("General", "Lesser General"))[0] == "LGPL-3.0"
    assert scanner.match("Licensed under CC BY-SA 4.0.")[0] == "CC-BY-SA-4.0"


def test_small_changes_are_counted(scanner):
    block = S.TEMPLATES["MIT"][1].replace("free of charge", "free of any charge").replace("hereby ", "")
    name, saved, missing, inserted = scanner.match(block)
    assert name == "MIT" and saved > 0.5 and (missing, inserted) == (1, 1)


def test_rows(spark):
    mit, gpl = S.TEMPLATES["MIT"][0], S.TEMPLATES["GPL-3.0"][0]
    rows = [(1, None), (2, ""), (None, mit), (3, f"{mit}\n{gpl}\n{mit}"), (3, f"{mit}\n{gpl}\n{mit}"), (4, "license? no"),
            (5, "plain words\n" * 100_000 + gpl), (6, "no cue here")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, found int, matches int")
    got = sorted(((r.doc_id, r.n_candidates, [(m.line, m.license, m.missing) for m in r.matches])
                  for r in S.scan(docs).collect()), key=repr)
    three = [(0, "MIT", 0), (1, "GPL-3.0", 0), (2, "MIT", 0)]
    assert got == sorted([(1, 0, []), (2, 0, []), (None, 1, [(0, "MIT", 0)]), (3, 3, three), (3, 3, three), (4, 1, []),
                          (5, 1, [(100_000, "GPL-3.0", 0)]), (6, 0, [])], key=repr)
    assert S.scan(docs.limit(0)).collect() == []


def test_given_documents_against_plain_search(spark, small):
    """Every line of the documents that is a short notice as it stands is found, and nothing else."""
    notices = {wording: name for name, wording in ALL}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        found = [(i, notices[line]) for i, line in enumerate(r.text.split("\n")) if line in notices]
        want[r.doc_id] = (",".join(sorted({n for _, n in found})), ",".join(str(i) for i, _ in found))
    got = {r.doc_id: (r.licenses, r.lines) for r in QUERIES["op6_license_scan"](spark, small).collect()}
    assert got == want and any(x for x, _ in want.values())


def varied(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(n))


def seen(text):
    return [(n.license, n.missing, n.inserted, text.count("\n", 0, n.start)) for n in S.Scanner().notices(text)]


@pytest.mark.parametrize("name,wording", ALL)
@pytest.mark.parametrize("width", [1, 2, 3, 6])
@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_notices_broken_anywhere(name, wording, width, mark):
    """Also where the first line holds no cue, and where a cue itself is broken."""
    own = wording.split()
    broken = "\n".join(mark + " ".join(own[i:i + width]) for i in range(0, len(own), width))
    assert seen(f"Some lines before it,\nand one more.\n{broken}\nAnd some behind it.") == [(name, 0, 0, 2)]


@pytest.mark.parametrize("text,license", [
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "MPL-2.0"),
    ("Released under the MIT\nLicense.", "MIT"), ("All rights\nreserved.", "proprietary"), ("All\u00a0rights\nreserved.", "proprietary"),
    ("This work is\nlicensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("Released into the public\ndomain under CC0 1.0.", "CC0-1.0")])
def test_wrapped_notices_in_rows(spark, text, license):
    rows = [(1, f"A line.\n{text}\nA line."), (2, text)]
    got = {r.doc_id: [(m.line, m.license, m.missing) for m in r.matches]
           for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(1, license, 0)], 2: [(0, license, 0)]}


@pytest.mark.parametrize("name,wording", ALL)
def test_exact_notices_in_long_lines_of_varied_prose(name, wording):
    """What compression saves in a long block depends on the prose, but by less than sets the notices apart."""
    rng = random.Random(wording)
    for _ in range(15):
        text = f"{varied(rng, rng.randint(60, 300))}. {wording} {varied(rng, rng.randint(60, 300))}."
        assert [f[:3] for f in seen(text)] == [(name, 0, 0)]


@pytest.mark.parametrize("a,one", ALL)
def test_two_notices_in_one_line(a, one):
    for b, two in ALL:
        for text in (f"{one} {two}", f"Some words. {one} Or by choice: {two} Some more."):
            assert sorted(f[:3] for f in seen(text)) == sorted([(a, 0, 0), (b, 0, 0)]), text


def test_many_notices_without_line_breaks(spark, monkeypatch):
    rng = random.Random(2)
    picked = [rng.choice(ALL) for _ in range(400)]
    text = " ".join(f"{wording} {varied(rng, rng.choice([0, 1, 5, 150]))}" for _, wording in picked)
    assert [f[:3] for f in seen(text)] == [(name, 0, 0) for name, _ in picked]
    monkeypatch.setattr(S, "TOGETHER", 2000)  # parts that overlap count nothing twice
    assert [f[:3] for f in seen(text)] == [(name, 0, 0) for name, _ in picked]
    got = S.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [m.license for m in got.matches] == [name for name, _ in picked]


def test_a_notice_within_another_is_found_too():
    one = S.TEMPLATES["GPL-3.0"][1].split()
    text = " ".join([*one[:20], "All rights reserved.", *one[20:]])
    assert sorted(f[:3] for f in seen(text)) == [("GPL-3.0", 0, 0), ("proprietary", 0, 0)]


CHANGED = "in compliance with", "as allowed by"


def test_the_saving_ranks_and_the_wording_confirms(monkeypatch):
    """A changed long notice beats the exact short one within it, which by wording alone would win."""
    long = max(S.TEMPLATES["Apache-2.0"], key=len).replace(*CHANGED)
    text = f"Some words. {long}. Some more."
    (n,) = S.Scanner().notices(text)
    assert text[n.start:n.stop] == long and (n.missing, n.inserted) == (3, 3) and n.saved_bytes > 50
    monkeypatch.setattr(S.Scanner, "savings", lambda self, block, templates: [(0, t) for t in templates])
    assert [text[n.start:n.stop] for n in S.Scanner().notices(text)] != [long]


def test_savings_are_those_of_zstandard():
    import zstandard
    scanner = S.Scanner()
    block = "Some words. " + S.TEMPLATES["MIT"][0]
    plain = len(zstandard.ZstdCompressor(level=S.LEVEL).compress(block.encode()))
    for saved, template in scanner.savings(block, scanner.templates):
        (wording,) = [w for own in S.TEMPLATES.values() for w in own if S.words(w) == template.words]
        raw = zstandard.ZstdCompressionDict(wording.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        assert saved == plain - len(zstandard.ZstdCompressor(level=S.LEVEL, dict_data=raw).compress(block.encode()))


@pytest.mark.parametrize("seed", range(4))
def test_planted_variants_against_brute_force(seed):
    """Every template, at most a word in ten dropped or doubled, in varied prose: the license that holds most is found."""
    rng = random.Random(seed)
    for name, wording in ALL:
        own = wording.split()
        if len(own) >= 20:  # shorter ones may lose nothing, or one word by which versions differ
            for _ in range(len(own) // 25):
                at = rng.randrange(1, len(own) - 1)
                own[at:at + 1] = rng.choice([[], [own[at], "indeed"]])
        text = f"{varied(rng, 40)}. {' '.join(own)} {varied(rng, 40)}."
        held = S.words(text)
        best = min((S.differences(t.words, held)[:2], t.license) for t in S.Scanner().templates
                   if len(t.words) >= 0.8 * len(S.words(wording)))
        assert [(n.license, n.missing) for n in S.Scanner().notices(text)] == [(name, best[0][0])]
        assert best[1] == name


@pytest.mark.parametrize("text,license", [
    ("Licensed under the MIT license.", "MIT"), ("Licensed under the Apache License 2.0", "Apache-2.0"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("# spdx-license-identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("/* SPDX-License-Identifier: LGPL-3.0-only */", "LGPL-3.0")])
def test_identifiers_and_common_short_forms(text, license):
    assert seen(f"A line.\n{text}\nA line.") == [(license, 0, 0, 1)]


def test_a_whole_license_is_one_notice():
    text = max(S.TEMPLATES["MIT"], key=len)
    assert len(text) > 900 and seen(f"MIT License\n\n{text}\n") == [("MIT", 0, 0, 2)]
