"""Run detection against brute force, on random sequences, odd rows and the query's planted cycles."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm import queries, run_detection
from docmill.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, min_length=12):
    """(start, length, period) of all runs, by start, then period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            first = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - first + q >= max(min_length, 2 * q):
                found.setdefault((first, i - first + q), q)
            i = max(i, first) + 1 if i == first else i
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def wanted(doc, text):
    words = WORD.findall(text or "")
    runs = brute(words)
    return doc, len(words), runs, collapsed(words, runs)


def got(df):
    return [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in df.collect()]


LONG = " ".join(f"w{i * i % 977}" for i in range(3000))
ROWS = [
    (1, "a " * 11), (2, "a " * 12), (3, "a\tb\n" * 6), (4, "a b c " * 3), (5, "a b c " * 4 + "a"), (6, None), (7, ""), (8, " \n\t "),
    (9, "x " + "a b " * 20 + "a c " + "a b c d e f g " * 2), (9, "x " * 30), (9, "x " * 30), (None, "y z " * 9), (None, None),
    (10, "Aa aA " * 8), (11, "é\x85é é\xa0é " * 10), (12, LONG), (13, LONG + " " + LONG), (14, "q " * 5000 + "r " + "q " * 4000),
    (15, "a a b " * 50 + "a a c " * 50), (16, "one"), (17, "\x0b\x0cx\r" * 40),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(d, t, 1, "x", 2) for d, t in ROWS],
                                 "doc_id long, text string, runs int, collapsed string, n_words int").coalesce(1)


def test_brute_force_with_odd_rows(rows):
    assert got(run_detection.detect(rows)) == [wanted(*r) for r in ROWS]


def test_slices_and_blocks_do_not_matter(rows):
    want = [wanted(*r) for r in ROWS]
    assert got(run_detection.detect(rows, slice_bytes=1)) == want
    assert got(run_detection.detect(rows, slice_bytes=100, block_pairs=7)) == want


def test_empty_table(rows):
    assert got(run_detection.detect(rows.limit(0))) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5), st.integers(1, 14), st.integers(1, 40))
def test_random_sequences(docs, min_length, block_pairs):
    sizes = np.array([len(d) for d in docs], np.int64)
    words = np.array([x for d in docs for x in d], np.int64)
    found = run_detection.runs_of(words, sizes, min_length, block_pairs)
    assert [tuple(map(int, r)) for r in zip(*found)] == [(i, *r) for i, d in enumerate(docs) for r in brute(d, min_length)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=1, max_size=200))
def test_extensions(values):
    numbers = np.array([*values, 2], np.int64)
    pairs = np.array([(i, j) for i in range(len(numbers)) for j in range(i + 1, len(numbers))], np.int64)
    def common(i, j):
        n = 0
        while j + n < len(numbers) and numbers[i + n] == numbers[j + n]:
            n += 1
        return n
    assert run_detection.Extensions(numbers).of(pairs[:, 0], pairs[:, 1]).tolist() == [common(*p) for p in pairs.tolist()]


def test_cover_reaches_every_pair():
    assert {(a - b) % run_detection.PERIOD for a in run_detection.COVER for b in run_detection.COVER} == set(range(13))


def planted(doc, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def test_query_on_given_tables(spark, small):
    found = {r.doc_id: r for r in queries.op12_run_detection(spark, small).collect()}
    docs = table(spark, small, "documents").collect()
    assert len(found) == len(docs)
    for doc in docs:
        words = planted(doc.doc_id, doc.text)
        runs = brute(words)
        row = found[doc.doc_id]
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()


def test_planted_cycles_of_odd_rows(spark):
    rows = [(d, t) for d in [*range(60), None] for t in (None, "", " ", "a", "a b c d e f g h i j k l m n o p", LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [WORD.findall(r.text or "") for r in queries.with_cycles(docs).collect()]
    assert got == [planted(*r) for r in rows]
