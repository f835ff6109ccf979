"""The FM-index and the decontamination operator against brute force."""

import random
import re

import numpy as np
import pytest

from docmill.llm import decontamination as D


def brute_words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, window=13):
    phrases = {}
    for item, text in items:
        words = brute_words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            owner = phrases.setdefault(tuple(words[i:i + window]), set())
            if item is not None:
                owner.add(str(item))
    out = []
    for doc, text in docs:
        words, hit, owners = brute_words(text), set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(words) - n + 1):
                if (found := phrases.get(tuple(words[i:i + n]))) is not None:
                    hit.update(range(i, i + n))
                    owners |= found
        out.append((doc, len(words), len(hit), sorted(owners), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order_search_and_locate(seed):
    rng = np.random.default_rng(seed)
    symbols = rng.integers(0, 2 + seed * 3, 400).astype(np.int64)
    symbols[-1] = 0
    separators = np.flatnonzero(symbols == 0)
    ranks = symbols + len(separators)
    ranks[separators] = np.arange(len(separators))
    order = D.suffix_order(symbols)
    assert order.tolist() == sorted(range(400), key=lambda i: ranks[i:].tolist())
    index = D.FMIndex(symbols, sample=7)
    for n in (1, 2, 5):
        patterns = np.unique(rng.integers(1, 4 + seed * 3, (60, n)), axis=0)
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(400 - n + 1) if (symbols[i:i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_long_repeats_are_sorted():
    symbols = np.r_[np.ones(5000, np.int64), 0, np.ones(5000, np.int64), 0]
    index = D.FMIndex(symbols)
    low, high = index.search(np.ones((1, 13), np.int64))
    assert high[0] - low[0] == 2 * (5000 - 12)
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == [*range(4988), *range(5001, 9989)]


def cases():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["é", "日本", "Über"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([13, 14, 20, 30])))) for i in range(20)]
    items += [(50, "three little words"), (50, "other words for the same id"), (51, "three, little: WORDS!"), (52, None),
              (53, "..."), (None, "an item without id that has more than thirteen words in it so it is cut"), (54, "")]
    docs = [(None, None), (1, ""), (2, None), (3, "no hit here"), (4, "THREE little_words"), (5, items[0][1]), (5, items[0][1]),
            (6, items[1][1] + " " + items[1][1]), (7, "x " * 3000 + items[2][1] + " x" * 3000),
            (8, items[-2][1]), (9, " ".join(items[3][1].split()[:12])), (None, items[4][1])]
    for i in range(100, 160):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 120)))
        item = rng.choice(items)[1] or ""
        cut = rng.randrange(0, 12)
        docs.append((i, text + " " + " ".join(item.split()[cut:]) + " " + text[:40]))
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, "r", 1, []) for d, t in docs],
                                  "doc_id long, text string, row string, n_words int, spans array<int>"),
            spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long"))


@pytest.mark.parametrize("shard,block", [(2_000_000, 8_000_000), (500, 8_000_000), (1, 300)])
def test_brute_force_with_odd_rows(spark, shard, block):
    docs, items = cases()
    rows = D.hits(D.marked(*frames(spark, docs, items), block_chars=block, shard_words=shard)).collect()
    got = sorted(((r.row.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in rows), key=repr)
    assert got == brute(docs, items)
    for r in rows:
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_apply_takes_contaminated_documents_out(spark):
    docs, items = cases()
    d, b = frames(spark, docs, items)
    kept = D.apply(d, b)
    assert kept.schema == d.schema
    want = [x[0] for x in brute(docs, items) if not x[4]]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    docs, items = cases()
    d, b = frames(spark, docs, items)
    assert D.contamination(d.limit(0), b).collect() == []
    assert not any(r.contaminated for r in D.contamination(d, b.limit(0)).collect())
