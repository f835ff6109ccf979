"""Lexical search against a plain scorer, on given and odd rows."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docmill.llm import lexical_search, queries
from docmill.llm.common import LOWER, UPPER, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans(UPPER, LOWER)))


def brute(docs, items, k=50):
    counts = [(doc, Counter(terms(text))) for doc, text in docs]
    counts = [(doc, tf, sum(tf.values())) for doc, tf in counts if tf]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, tf, _ in counts for t in tf)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for doc, tf, n in counts:
            m = 100 - 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(terms(text)) if t in tf)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored, key=lambda r: r[:3])[:k], 1)]
    return sorted(out, key=repr)


DOCS = [
    (1, "Alpha beta GAMMA alpha"), (2, "alphabet beta-gamma"), (3, None), (4, ""), (5, "... --- !!"), (6, "alpha"),
    (7, "alpha"), (7, "alpha"), (None, "alpha"), (None, None), (-3, "alpha"), (8, "Éa éa naïve\x00naïve 東京 tower"),
    (9, "word " * 30_000 + "alpha"), (10, "x" * 200_000), (11, "alpha_beta{gamma}`delta^"), (12, "a a a a a b"),
    (13, "beta " * 3), (14, "nothing asked here"), (9_000_000_000, "alpha beta"),
]
ITEMS = [(1, "alpha"), (2, "ALPHA beta, beta; gamma"), (3, None), (4, ""), (5, "?!"), (6, "éa NAÏVE 東京"), (1, "alpha"),
         (1, "beta delta"), (None, "alpha a"), (7, "unknown"), (8, "x" * 200_000), (9, "a b")]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.createDataFrame([(d, t, 1, "x", 0) for d, t in DOCS],
                                 "doc_id long, text string, score int, item_id string, rank int").repartition(5)
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in ITEMS], "item_id long, text string, doc_id int, score int")
    return docs, items


def test_brute_force_with_odd_rows(frames):
    assert got(lexical_search.search(*frames)) == brute(DOCS, ITEMS)


def test_few_hits_and_many_blocks(frames):
    assert got(lexical_search.search(*frames, k=3, block_items=2)) == brute(DOCS, ITEMS, 3)
    assert got(lexical_search.search(*frames, k=1, block_chars=60_000)) == brute(DOCS, ITEMS, 1)


def test_small_buffers_keep_the_best(frames, monkeypatch):
    monkeypatch.setattr(lexical_search, "HELD", 2)
    assert got(lexical_search.search(*frames, k=2)) == brute(DOCS, ITEMS, 2)


def test_query_on_given_tables(spark, small):
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    assert got(queries.op11_lexical_search(spark, small)) == brute(docs, items)


def test_empty_tables(frames):
    docs, items = frames
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs.where("text IS NULL"), items).count() == 0


def test_ids_of_items_keep_their_type(frames):
    docs, items = frames
    named = items.withColumn("item_id", F.concat(F.lit("i"), "item_id"))
    rows = lexical_search.search(docs, named, k=1).where("item_id = 'i2'").collect()
    assert [(r.doc_id, r["rank"]) for r in rows] == [(d, n) for i, n, d, _ in brute(DOCS, ITEMS, 1) if i == 2]
