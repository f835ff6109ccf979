"""Edit-aware counts equal counts of the whole edited text, and encode little of it again."""

import json
import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from docmill.llm import token_counts as T
from docmill.llm.packing import byte_level_encoding
from docmill.llm.queries import vocabulary


@pytest.fixture(scope="module")
def count():
    return T.counter(vocabulary())


def edited(text, edits):
    for start, stop, new in sorted(edits, reverse=True):
        text = text[:start] + new + text[stop:]
    return text


BITS = [*" \n\t'aé1.", "  ", " the", "'re", "<mail>", " ", "日本", "\r\n", "   x", "", "word " * 120]


@pytest.mark.parametrize("seed", range(40))
def test_random_edits(count, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice([*BITS, "some words of prose, ", "it's 12 o'clock  "]) for _ in range(rng.randrange(0, 300)))
    tree = T.SegmentTree(T.leaves(text), count)
    assert tree.text == text and tree.tokens[1] == count(text)
    for _ in range(8):
        places = sorted(rng.randint(0, len(text)) for _ in range(2 * rng.randrange(1, 5)))
        edits = [(a, b, "".join(rng.choice(BITS) for _ in range(rng.randrange(0, 6)))) for a, b in zip(places[::2], places[1::2])]
        tree.edit(edits)
        text = edited(text, edits)
        assert tree.text == text and tree.tokens[1] == count(text)


def test_only_a_region_is_encoded_again(count):
    text = "plain words with spaces between them " * 5000
    tree = T.SegmentTree(T.leaves(text), count)
    tree.edit([(90_000, 90_004, "other")])
    assert tree.encoded < 5 * T.LEAF_CHARS and tree.tokens[1] == count(tree.text)


def test_bad_edits(count):
    tree = T.SegmentTree(T.leaves("some text"), count)
    with pytest.raises(ValueError):
        tree.edit([(0, 5, "a"), (4, 6, "b")])
    with pytest.raises(ValueError):
        tree.edit([(3, 99, "a")])


def test_rows(spark, count):
    rows = [(1, None, None), (2, "", []), (3, None, [(0, 0, "new text")]), (4, "a b c", [(0, 1, None), None, (2, 3, "x")]),
            (None, "no id", [(0, 2, "an")]), (5, "same", [(4, 4, "!")]), (5, "same", [(4, 4, "!")]),
            (6, "long words here " * 60_000, [(10, 20, "-"), (500_000, 500_100, "")])]
    docs = spark.createDataFrame([(d, t, e, 1) for d, t, e in rows],
                                 f"doc_id long, text string, changes {T.EDITS}, tree int")
    got = T.count_edited(docs, F.col("changes"), vocabulary()).collect()
    want = []
    for doc, text, edits in rows:
        edits = [(a, b, t or "") for e in edits or () if e for a, b, t in [e]]
        new = edited(text or "", edits) if edits else text
        want.append((doc, count(text or ""), count(new or ""), len(edits), new))
    assert sorted(((r.doc_id, r.n_tokens, r.n_tokens_after, r.n_edits, r.edited_text) for r in got), key=repr) == sorted(
        want, key=repr)
    assert max(r.chars_encoded for r in got) < 3000
    assert T.count_edited(docs.limit(0), F.col("changes"), vocabulary()).collect() == []


def test_a_stored_tree_goes_on(spark, count):
    text = "words of a stored document, with numbers 12 and more " * 40
    row = spark.createDataFrame([(text,), (None,)], "text string").select(T.trees(F.col("text"), vocabulary()).alias("t")).collect()
    parts, at = [], 0
    for size in row[0].t.leaf_chars:
        parts.append(text[at:at + size])
        at += size
    tree = T.SegmentTree(parts, count, row[0].t.leaf_tokens)
    assert tree.tokens[1] == row[0].t.n_tokens == count(text) and row[1].t.n_tokens == 0
    tree.edit([(700, 710, "x")])
    assert tree.text == text[:700] + "x" + text[710:] and tree.tokens[1] == count(tree.text)


def test_clean_up(spark, small, count):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = T.count_edited(docs, T.cleaning_edits, vocabulary()).collect()
    assert len(rows) == len(texts) and any(r.n_edits for r in rows)
    for r in rows:
        after = edited(texts[r.doc_id], T.cleaning_edits(texts[r.doc_id]))
        assert (r.edited_text, r.n_tokens, r.n_tokens_after) == (after, count(texts[r.doc_id]), count(after))
    assert T.cleaning_edits("a\nme@x.org 0123456789\na\nb\nb") == [
        (2, 10, "<mail>"), (11, 21, "<number>"), (21, 23, ""), (25, 27, "")]


ADDED = ["<|end of text|>", "a b", "z ", " the", "<s>"]


@pytest.fixture(scope="module")
def spaced():
    """The vocabulary with more added tokens, some of which hold a place to cut."""
    model = json.loads(vocabulary())
    model["added_tokens"] += [{"content": t, "id": 60_000 + i} for i, t in enumerate(ADDED)]
    return json.dumps(model)


@cache
def encoding(spec):
    return byte_level_encoding(spec)


def packed_ids(spec, text):
    return len(encoding(spec).encode(text, allowed_special="all"))


def test_added_tokens_count_as_in_packing(spark, count):
    text = "one<|endoftext|> two <|endoftext|>" + " words of prose" * 40
    assert count("<|endoftext|>") == 1
    rows = [(1, text, [(5, 6, "")]), (2, "a <|endof" + " more" * 200, [(9, 9, "text|>")])]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, changes {T.EDITS}")
    for r in T.count_edited(docs, F.col("changes"), vocabulary()).collect():
        before = dict((d, t) for d, t, _ in rows)[r.doc_id]
        assert (r.n_tokens, r.n_tokens_after) == (packed_ids(vocabulary(), before), packed_ids(vocabulary(), r.edited_text))


@pytest.mark.parametrize("seed", range(30))
def test_added_tokens_never_lie_across_a_cut(spaced, seed):
    rng, count, added = random.Random(seed), T.counter(spaced), T.breakable(spaced)
    assert added == ADDED[:3]  # in the others no space stands behind another character
    bits = [*ADDED, "<|end", " of", " text|>", "a", " b", " ", "x" * 60, "z", " words of prose, ", "<|endoftext|>", "the x"]
    text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 400)))
    tree = T.SegmentTree(T.leaves(text, added=added), count, added=added)
    assert tree.text == text and tree.tokens[1] == packed_ids(spaced, text)
    for _ in range(8):
        places = sorted(rng.randint(0, len(text)) for _ in range(2 * rng.randrange(1, 5)))
        edits = [(a, min(b, a + 20), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 3))))
                 for a, b in zip(places[::2], places[1::2])]
        tree.edit(edits)
        text = edited(text, edits)
        assert tree.text == text and tree.tokens[1] == packed_ids(spaced, text)
