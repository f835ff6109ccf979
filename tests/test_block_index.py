"""The pruned BM25 search against the plain one."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmill.operators import block_index as BI, keyword_search as KS
from docmill.session import scratch_path


def rows(df):
    return sorted((r.qid, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def library(spark):
    """Zipf-like words, texts of very different lengths, copies, empty and null texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    texts = [" ".join(rng.choices(words, weights, k=rng.choice([3, 20, 60, 200]))) for _ in range(3000)]
    texts += texts[:200] + ["", None, "w0 " * 5000, "?!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    plain, blocks = scratch_path(spark, "plain"), scratch_path(spark, "blocks")
    KS.write_index(docs, plain, partitions=4)
    BI.write_index(docs, blocks, partitions=4)
    return plain, blocks


ASKED = [(0, "w0"), (1, "w0 w1"), (2, "w3 w390"), (3, "w399"), (4, "nothing"), (5, ""), (6, None),
         (7, " ".join(f"w{i}" for i in range(0, 400, 9))), (8, "w2 W2 w5 w7"), (9, "w0 w1 w2 w3 w4 w5")]


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_hits_are_those_of_the_plain_search(spark, library, k):
    asked = spark.createDataFrame(ASKED, "qid int, text string")
    want = rows(KS.bm25_top_k(spark, library[0], asked, k))
    assert rows(BI.bm25_top_k(spark, library[1], asked, k)) == want and want


def test_other_parameters_keep_the_result(spark, library):
    asked = spark.createDataFrame(ASKED, "qid int, text string")
    for k1, b in ((0.4, 0.0), (2.0, 1.0)):
        assert rows(BI.bm25_top_k(spark, library[1], asked, 5, k1=k1, b=b, block_rows=4)) == rows(
            KS.bm25_top_k(spark, library[0], asked, 5, k1=k1, b=b))


@pytest.mark.parametrize("text", ["w0", "w1", "w7"])
def test_common_terms_move_less_than_half_of_their_postings(spark, library, text):
    asked = spark.createDataFrame([(0, text)], "qid int, text string")
    everything = KS.asked_index(spark, library[1], asked)[0].count()
    assert everything > 500 and BI.pruned(spark, library[1], asked, 10)[0].count() < everything / 2


def test_bounds_hold(spark, library):
    asked = spark.createDataFrame(ASKED, "qid int, text string")
    postings, weighted = KS.asked_index(spark, library[1], asked)
    flat = weighted.select("qid", "mean_length", F.explode("terms").alias("t")).select("qid", "mean_length", "t.*")
    bound = BI.bounds(spark, library[1], flat)
    hits = KS.best_of(postings, weighted, 5000)
    block = postings.select("doc_id", "block").distinct()
    over = hits.join(block, "doc_id").join(bound, ["qid", "block"], "left").where(
        F.col("bound").isNull() | (F.col("score") > F.col("bound") * (1 + BI.ROUNDING)))
    assert over.count() == 0


def test_empty_corpus_and_no_queries(spark, library):
    path = scratch_path(spark, "blocks")
    BI.write_index(spark.createDataFrame([], "doc_id long, text string"), path, partitions=2)
    asked = spark.createDataFrame(ASKED, "qid int, text string")
    assert rows(BI.bm25_top_k(spark, path, asked, 3)) == []
    assert rows(BI.bm25_top_k(spark, library[1], asked.limit(0), 3)) == []
    with pytest.raises(ValueError):
        BI.bm25_top_k(spark, path, asked, 0)


def test_kernels_take_bounded_pieces(spark):
    """The postings of a batch come from pieces of a few tokens, and are the same."""
    lists = [["a", "b", "a"], [], None, ["c"] * 7, ["a"], ["b", "a"]]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "tokens": pa.array([x or [] for x in lists], pa.list_(pa.string()))})
    pieces = list(KS.bounded(iter([batch, batch.slice(3)]), 1, 4))
    assert [p.column(0).to_pylist() for p in pieces] == [[0, 1, 2], [3], [4, 5], [3], [4, 5]]
    docs = spark.createDataFrame([(i, " ".join(x or [])) for i, x in enumerate(lists)], "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r) for r in KS.postings_of(docs).collect() if r.term != KS.EVERY)
    assert got == [("a", 0, 2, 3), ("a", 4, 1, 1), ("a", 5, 1, 2), ("b", 0, 1, 3), ("b", 5, 1, 2), ("c", 3, 7, 7)]
