"""Chunkers against literal cases and an independent greedy packer."""

import itertools
import re

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docmill.functions.text import words
from docmill.operators import chunking as C
from docmill.workload.fixtures import documents

EDGE = ["", " ", "one", "Para 1.\n\nPara 2.\n\nPara 3.", "a\n\n\n\nb", "x" * 1200, "x" * 1200 + "\n\nshort",
        "short\n\n" + "y" * 1300 + "\n\nend", "a b  c\td e f", "One. Two!  Three? four", "\x1ctail\x1d",
        "Stop.\nNext line. Éa ê.", " lead and trail \n\n ", "w" * 30 + " b", "😀 😀 " * 40, "...", "a. b. c"]


def all_chunks(spark, texts, column):
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(texts)), "text": texts}), "i int, text string")
    return [r[0] for r in df.orderBy("i").select(column.alias("c")).collect()]


def cut(sizes, limit):
    """Greedy groups as index ranges: a new group starts when the next piece does not fit."""
    groups, begin, used = [], 0, 0
    for i, size in enumerate(sizes):
        if used + size > limit:
            groups.append((begin, i))
            begin, used = i, 0
        used += size
    return [*groups, (begin, len(sizes))]


def by_chars(pieces, limit, sep):
    ranges = cut([len(p) + len(sep) for p in pieces], limit)
    return [sep.join(pieces[a:b]).strip() for a, b in ranges if a < b]


def by_words(text, limit):
    ws = text.split()
    return [" ".join(ws[a:b]) for a, b in cut([len(w) + 1 for w in ws], limit)] if ws else []


def by_tokens(text, limit, sep):
    ps = text.split(sep)
    return [sep.join(ps[a:b]) for a, b in cut([len(p.split()) for p in ps], limit)]


def split_sentences(text):
    return re.split(r"(?<=[.!?]) +", text.strip())


def check_all(spark, texts):
    x = F.col("text")
    cases = [
        (C.raw_paragraphs(x), lambda t: t.split("\n\n")),
        (C.clean_paragraphs(x), lambda t: [p.strip() for p in t.split("\n\n") if p.strip()]),
        (C.packed_paragraphs(x, 40), lambda t: by_chars(t.split("\n\n"), 40, "\n\n")),
        (C.packed_paragraphs(x), lambda t: by_chars(t.split("\n\n"), 1000, "\n\n")),
        (C.packed_words(x, 20), lambda t: by_words(t, 20)),
        (C.packed_sentences(x, 25), lambda t: by_chars(split_sentences(t), 25, " ")),
        (C.packed_tokens(x, 3), lambda t: by_tokens(t, 3, "\n\n")),
        (C.token_windows(x, 3), lambda t: [" ".join(t.split()[i:i + 3]) for i in range(0, len(t.split()), 3)]),
        (C.line_groups(x, 2), lambda t: ["\n".join(t.split("\n")[i:i + 2]) for i in range(0, len(t.split("\n")), 2)]),
    ]
    for column, expected in cases:
        got = all_chunks(spark, texts, column)
        assert got == [expected(t) for t in texts]


def test_edge_cases(spark):
    check_all(spark, EDGE)


PIECE = st.text(alphabet="ab .!?\n\t é😀", max_size=120)


@settings(max_examples=3, deadline=None)
@given(st.lists(PIECE, min_size=25, max_size=60))
def test_random_texts(spark, texts):
    check_all(spark, texts)


def test_given_documents(spark, small):
    texts = [r[0] for r in documents(spark, small).select("text").collect()]
    check_all(spark, texts)


def test_literal_expectations(spark):
    three = all_chunks(spark, ["Para 1.\n\nPara 2.\n\nPara 3."], C.clean_paragraphs(F.col("text")))[0]
    assert len(three) == 3 and three[0] == "Para 1."
    lines = all_chunks(spark, ["line1\nline2\nline3\nline4\nline5"], C.line_groups(F.col("text"), 2))[0]
    assert len(lines) == 3 and lines[1] == "line3\nline4"


def test_oversize_first_piece_leaves_an_empty_chunk(spark):
    assert all_chunks(spark, ["abcdefgh ij"], C.packed_words(F.col("text"), 5)) == [["", "abcdefgh", "ij"]]
    assert all_chunks(spark, ["a b c\n\nd"], C.packed_tokens(F.col("text"), 2)) == [["", "a b c", "d"]]
    assert all_chunks(spark, [""], C.packed_paragraphs(F.col("text"))) == [[""]]
    assert all_chunks(spark, [""], C.packed_words(F.col("text"))) == [[]]


def test_overlapping_windows(spark):
    texts = ["", "abc", "abcdefghij", "abcdefghijk", "x" * 95]
    for text, got in zip(texts, all_chunks(spark, texts, C.overlapping(F.col("text"), 10, 3))):
        assert got[0] + "".join(c[3:] for c in got[1:]) == text
        assert all(len(c) == 10 for c in got[:-1]) and len(got[-1]) <= 10
        assert all(a[-3:] == b[:3] for a, b in zip(got, got[1:]))


def test_separator_aware(spark, small):
    given_texts = [r[0] for r in documents(spark, small).select("text").collect()]
    serial = itertools.count()
    texts = [re.sub(r"\w+", lambda m: f"w{next(serial)}", t) for t in given_texts]  # every word is unique
    for text, got in zip(texts, all_chunks(spark, texts, C.separator_aware(F.col("text"), 300, 50))):
        assert all(0 < len(c) <= 300 for c in got)
        at = 0  # chunks follow the text in order and leave out only white space
        for c in got:
            found = text.find(c, max(0, at - 60))
            assert found >= 0 and not text[at:found].strip()
            at = max(at, found + len(c))
        assert not text[at:].strip()
    for got in all_chunks(spark, ["z" * 5000, "", "a b " * 2000], C.separator_aware(F.col("text"), 300, 50)):
        assert all(0 < len(c) <= 300 for c in got)


def split_keeping(text, sep):
    if sep == "":
        return list(text)
    head, *rest = text.split(sep)
    return [p for p in [head, *(sep + r for r in rest)] if p]


def windows(pieces, size, overlap):
    out, first, held = [], 0, 0
    for i, piece in enumerate(pieces):
        if held + len(piece) > size and i > first:
            out.append("".join(pieces[first:i]).strip())
            while held > overlap or (held > 0 and held + len(piece) > size):
                held -= len(pieces[first])
                first += 1
        held += len(piece)
    return [c for c in [*out, "".join(pieces[first:]).strip()] if c]


def split_plainly(text, size, overlap, separators=C.SEPARATORS):
    """The same splitter piece by piece."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer, out, short = separators[at + 1:], [], []
    for piece in split_keeping(text, separators[at]):
        if len(piece) < size:
            short.append(piece)
            continue
        out += windows(short, size, overlap) if short else []
        short = []
        out += split_plainly(piece, size, overlap, finer) if finer else [piece]
    return out + (windows(short, size, overlap) if short else [])


@pytest.mark.parametrize("size,overlap", [(300, 50), (40, 15), (9, 0), (4, 2), (2000, 200)])
def test_separators_like_plain_python(spark, small, size, overlap):
    texts = [r[0] for r in documents(spark, small).select("text").collect()][:60 if size > 100 else 12]
    texts = [t[:3000] if size < 100 else t for t in texts] + [
        "aa bb cc dd", "one\n\ntwo\n\nthree", "abcdefghij", "", " ", "\n\n\n", "z" * 700, "a b " * 300, "x.\n\ny. z" * 40,
        "short\n\n" + "long " * 30 + "\n\nshort\n\nshort", "🙂" * 50, "é ü.ß" * 30]
    got = all_chunks(spark, texts, C.separator_aware(F.col("text"), size, overlap))
    for text, own in zip(texts, got):
        assert own == split_plainly(text, size, overlap), text[:80]


def test_separators_leave_null_texts_out(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "doc_id int, text string")
    assert [r.doc_id for r in C.chunk(df, "separators").collect()] == [2]


def test_dispatch(spark):
    with pytest.raises(ValueError, match="no chunking strategy"):
        C.chunks_of(F.col("text"), "pages")
    with pytest.raises(ValueError, match="needs a tokenizer"):
        C.chunks_of(F.col("text"), "token")
    df = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    rows = C.chunk(df, "token", size=2, tokenizer=words).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.chunk) for r in rows] == [(0, "a b"), (1, "c d"), (2, "e")]
    joined = C.token_windows(F.col("text"), 2, words, decode=lambda ts: F.array_join(ts, "+"))
    assert df.select(joined).first()[0] == ["a+b", "c+d", "e"]


def test_python_tokenizers(spark):
    @F.pandas_udf("array<string>")
    def pairs(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [t[i:i + 2] for i in range(0, len(t), 2)])

    @F.pandas_udf("array<int>")
    def counts(pieces: pd.Series) -> pd.Series:
        return pieces.map(lambda ps: [-(-len(p) // 2) for p in ps])

    texts = ["abcde\n\nfg\n\nh", "", "abcdefghij\n\nk"]
    x = F.col("text")
    assert all_chunks(spark, texts, C.token_windows(x, 2, pairs)) == [
        ["ab cd", "e\n \nf", "g\n \nh"], [], ["ab cd", "ef gh", "ij \n\n", "k"]]
    assert all_chunks(spark, texts, C.packed_tokens(x, 4, counter=counts)) == [
        ["abcde\n\nfg", "h"], [""], ["", "abcdefghij", "k"]]


def test_words_are_kept_in_order(spark, small):
    rows = C.chunk(documents(spark, small), "fixed_char", size=200).orderBy("doc_id", "chunk_id").collect()
    back = {}
    for r in rows:
        back.setdefault(r.doc_id, []).extend(r.chunk.split())
    for r in documents(spark, small).collect():
        assert back.get(r.doc_id, []) == r.text.split()


def test_chunking_does_not_shuffle(spark, small, plan):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for strategy in ("paragraph", "fixed_char", "sentence", "lines"):
        options = {"lines": 2} if strategy == "lines" else {}
        text = plan(C.chunk(docs, strategy, **options))
        assert "Exchange" not in text and "Python" not in text
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
