"""Vector, keyword and hybrid search against brute force, in both physical forms."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import filters, keyword_search as KS, quality, topk, vector_search as VS
from docmill.plans import answer
from docmill.session import scratch_path
from docmill.sources import tables

DIM = 6


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, DIM)), 3)
    x[100:200] = x[50]  # a third of all rows are copies of one vector
    rows = [(i, [float(v) for v in r], ["public", "team", None][i % 3]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows + [(900, None, "public")], "vec_id long, embedding array<double>, acl string")
    return df.repartition(5), x


@pytest.fixture(scope="module")
def asked(spark):
    q = np.round(np.random.default_rng(4).normal(size=(23, DIM)), 3)
    q[7] = 0
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)],
                                 "qid long, embedding array<double>"), q


def exact(x, q, k, keep=None):
    out = set()
    for qi, v in enumerate(q):
        d = VS.exact_distances(np.broadcast_to(v, x.shape), x)
        ids = [i for i in range(len(x)) if keep is None or keep(i)]
        for rank, i in enumerate(sorted(ids, key=lambda i: (d[i], i))[:k], 1):
            out.add((qi, i, round(float(d[i]), 6), rank))
    return out


def rows(df):
    return {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()}


def test_exact_search(vectors, asked):
    (df, x), (queries, q) = vectors, asked
    for k in (1, 5, 120):
        want = exact(x, q, k)
        assert rows(VS.vector_top_k(df, queries, k)) == want
        assert rows(VS.vector_top_k(df, queries, k, block_rows=5)) == want  # many blocks
        assert rows(VS.vector_top_k(df, queries, k, block_bytes=300)) == want


def test_fewer_rows_than_k(vectors, asked):
    (df, x), (queries, q) = vectors, asked
    assert rows(VS.vector_top_k(df.where("vec_id < 3"), queries, 10)) == exact(x[:3], q, 10)
    assert rows(VS.vector_top_k(df.where("vec_id < 0"), queries, 10)) == set()
    assert rows(VS.vector_top_k(df, queries.where("qid < 0"), 10)) == set()
    with pytest.raises(ValueError):
        VS.vector_top_k(df, queries, 0)


def test_access_filter(vectors, asked):
    (df, x), (queries, q) = vectors, asked
    public = lambda i: i % 3 == 0
    assert rows(VS.vector_top_k(df, queries, 5, acl="public")) == {r for r in exact(x, q, 5) if public(r[1])}
    assert rows(VS.vector_top_k(df, queries, 5, acl="public", mode="pre")) == exact(x, q, 5, public)
    with pytest.raises(ValueError):
        VS.vector_top_k(df, queries, 5, acl="public", mode="maybe")


def test_string_ids(vectors, asked):
    (df, x), (queries, q) = vectors, asked
    named = df.withColumn("vector_id", F.format_string("v%03d", F.col("vec_id")))
    got = rows(VS.vector_top_k(named, queries, 5, id_col="vector_id"))
    assert got == {(a, f"v{b:03d}", c, d) for a, b, c, d in exact(x, q, 5)}


def test_dimensions_must_agree(spark, asked):
    bad = spark.createDataFrame([(1, [1.0] * DIM), (2, [1.0] * (DIM - 1))], "vec_id long, embedding array<double>").coalesce(1)
    with pytest.raises(Exception, match="dimension"):
        VS.vector_top_k(bad, asked[0], 1).collect()


def test_search_plan_moves_no_vectors(vectors, asked, plan):
    for blocks in (100, 5):
        text = plan(VS.vector_top_k(vectors[0], asked[0], 5, block_rows=blocks))
        assert "CartesianProduct" not in text and "NestedLoop" not in text and "Generate" not in text
        assert text.count("WindowGroupLimit") == 2  # limited before and after the only shuffle of hits
        assert text.count("hashpartitioning(") == 1 and "embedding" not in text.split("hashpartitioning(")[0]


@pytest.mark.parametrize("scale,shift", [(1e-4, 0.0), (1.0, 1e6), (1e6, 0.0), (3e-5, 1.0)])
def test_small_large_and_near_vectors(spark, scale, shift):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, DIM)) * scale + shift
    x[10:20] = x[3]  # ties go by id
    q = x[[3, 50, 199]]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    asks = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "qid long, embedding array<double>")
    got = {}
    for r in VS.vector_top_k(df, asks, 12).collect():
        got.setdefault(r.qid, {})[r["rank"]] = (r.vec_id, r.distance)
    for i, v in enumerate(q):
        d = VS.exact_distances(np.broadcast_to(v, x.shape), x)
        want = sorted(range(200), key=lambda j: (d[j], j))[:12]
        assert [got[i][n] for n in range(1, 13)] == [(j, d[j]) for j in want]
    assert got[1][1][0] == 50 and got[2][1][0] == 199


def test_distances_are_within_the_slack():
    rng = np.random.default_rng(2)
    for scale, shift in ((1.0, 0.0), (1e-9, 1.0), (1.0, 1e8)):
        q, x = rng.normal(size=(20, 64)) * scale + shift, rng.normal(size=(300, 64)) * scale + shift
        fast, slack = VS.squared_distances(q, x), VS.distance_slack(q, x)
        exact_ = np.array([VS.exact_distances(np.broadcast_to(v, x.shape), x) for v in q])
        assert (np.abs(fast - exact_) <= slack).all()


def test_inverted_lists(vectors, asked):
    (df, x), (queries, q) = vectors, asked
    df = df.where("embedding is not null")
    lists = VS.train_lists(df, 6)
    assigned = VS.assign_lists(df, lists)
    centres = {r.list_id: np.array(r.embedding) for r in lists.collect()}
    for r in assigned.collect():
        d = {i: float(VS.exact_distances(np.array([r.embedding]), c[None])[0]) for i, c in centres.items()}
        assert r.list_id == min(d, key=lambda i: (d[i], i))
    every = exact(x, q, 5)
    assert rows(VS.probe_top_k(assigned, lists, queries, 5, nprobe=6)) == every
    assert rows(VS.probe_top_k(assigned, lists, queries, 5, nprobe=6, block_rows=4)) == every
    two = VS.probe_top_k(assigned, lists, queries, 5, nprobe=2)
    assert rows(two) == rows(VS.probe_top_k(assigned, lists, queries, 5, nprobe=2, block_rows=4))
    report = VS.recall(two, VS.vector_top_k(df, queries, 5)).first()
    assert report.hits == 115 and 0 < report.recall <= 1


def test_probing_reads_only_the_probed_lists(spark, vectors, asked, plan):
    lists = VS.train_lists(vectors[0].where("embedding is not null"), 6)
    path = scratch_path(spark, "lists")
    tables.write_lists(VS.assign_lists(vectors[0].where("embedding is not null"), lists), path)
    one = asked[0].where("qid = 0")
    found = VS.probe_top_k(spark.read.parquet(path), lists, one, 5, nprobe=2)
    text = plan(found)
    assert "PartitionFilters: [list_id" in text and "acl" not in text.split("ReadSchema")[1]
    assert rows(found) == rows(VS.probe_top_k(VS.assign_lists(vectors[0].where("embedding is not null"), lists),
                                              lists, one, 5, nprobe=2))


def test_many_lists_come_in_blocks(vectors, asked, plan):
    (df, _), (queries, q) = vectors, asked
    lists = queries.select(F.col("qid").cast("int").alias("list_id"), "embedding")
    few = VS.with_lists(df, lists, 3)
    many = VS.with_lists(df, lists, 3, block_rows=4)
    shape = lambda rs: {r.vec_id: [(x.distance, x.list_id) for x in r.lists] for r in rs.collect()}
    assert shape(few) == shape(many) and shape(few)[900] == []  # no vector, no list
    assert "Exchange" not in plan(many)
    assigned = VS.assign_lists(df, lists).where("vec_id = 900").first()
    assert assigned.list_id is None and assigned.list_distance is None


def test_a_row_without_a_vector_is_not_found(vectors, asked):
    (df, x), (queries, q) = vectors, asked
    lists = VS.train_lists(df.where("embedding is not null"), 6)
    assert rows(VS.probe_top_k(VS.assign_lists(df, lists), lists, queries, 5, nprobe=6)) == exact(x, q, 5)


def cos(a, b):
    n = math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())
    return float(a @ b / n) if n else 0.0


def test_mmr(vectors, asked):
    (df, x), (queries, q) = vectors, asked
    got = {}
    for r in VS.mmr_top_k(df.where("embedding is not null"), queries, 4, 10).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.vec_id
    for qi, v in enumerate(q):
        pool = [i for _, i, _, _ in sorted((r for r in exact(x, q, 10) if r[0] == qi), key=lambda r: r[3])]
        taken = []
        while len(taken) < 4:
            def value(i):
                near = max((cos(x[i], x[j]) for j in taken), default=0.0)
                return round(0.5 * cos(x[i], v) - 0.5 * near, 9)  # copies of a vector tie
            left = [i for i in pool if i not in taken]
            taken.append(max(left, key=lambda i: (value(i), -pool.index(i))))
        assert [got[qi][n] for n in range(1, 5)] == taken


DOCS = {1: "red fox jumps", 2: "red red red", 3: "the fox and the hound", 4: "", 5: "blue whale, blue sea", 6: "fox",
        **{100 + i: "the copy of one text" for i in range(30)}}
ASKS = {0: "red fox", 1: "the", 2: "nothing here", 3: "blue Blue fox", 4: "copy"}


def bm25(k, docs=DOCS, asks=ASKS):
    toks = {d: re.findall(r"\w+", t.lower()) for d, t in docs.items()}
    mean = sum(map(len, toks.values())) / len(toks)
    df = Counter(w for ws in toks.values() for w in set(ws))
    out = set()
    for qid, text in asks.items():
        scores = {}
        for d, ws in toks.items():
            tf = Counter(ws)
            s = sum(math.log(1 + (len(toks) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2
                    / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set(re.findall(r"\w+", text.lower())) if tf[w])
            if s:
                scores[d] = round(s, 6)
        for rank, d in enumerate(sorted(scores, key=lambda d: (-scores[d], d))[:k], 1):
            out.add((qid, d, scores[d], rank))
    return out


@pytest.fixture(scope="module")
def library(spark):
    docs = spark.createDataFrame(list(DOCS.items()), "doc_id long, text string").repartition(4)
    return docs, spark.createDataFrame(list(ASKS.items()), "qid long, text string")


@pytest.fixture(scope="module")
def stored(spark, library):
    path = scratch_path(spark, "keywords")
    KS.write_index(library[0], path, partitions=4)
    return path


def test_bm25(spark, library, stored):
    docs, asks = library
    assert rows(KS.bm25_top_k(spark, stored, asks, 7)) == bm25(7)
    assert rows(KS.bm25_top_k(spark, stored, asks, 7, block_rows=2)) == bm25(7)
    one = KS.bm25_top_k(spark, stored, asks.where("qid = 0"), 7)
    assert rows(one) == {r for r in bm25(7) if r[0] == 0}


def test_bm25_reads_only_asked_partitions_and_no_text(spark, library, stored, plan):
    one = KS.asked_index(spark, stored, library[1].where("qid = 1"))[0]
    text = plan(one)
    assert re.search(r"PartitionFilters: \[[^\]]*part#", text) and "text:" not in text
    assert {r.term for r in one.select("term").distinct().collect()} == {"the"}


def test_bm25_index(spark, library, stored):
    found = {r.term: r.df for r in KS.terms_of(spark, stored).collect()}
    assert found == dict(Counter(w for t in DOCS.values() for w in set(re.findall(r"\w+", t.lower()))))
    postings = spark.read.parquet(f"{stored}/postings").where("term <> ''").collect()
    assert {(r.term, r.doc_id): (r.tf, r.length) for r in postings} == {
        (w, d): (n, len(re.findall(r"\w+", t))) for d, t in DOCS.items() for w, n in Counter(re.findall(r"\w+", t.lower())).items()}


def test_bm25_without_matches(spark, library, stored):
    docs, asks = library
    assert rows(KS.bm25_top_k(spark, stored, asks.where("qid = 2"), 3)) == set()
    path = scratch_path(spark, "keywords")
    KS.write_index(docs.where("doc_id < 0"), path, partitions=4)
    assert rows(KS.bm25_top_k(spark, path, asks, 3)) == set()


def test_equal_documents_tie_by_id(spark):
    """Scores of copies are equal wherever they stand, so ranks do not depend on the order of sums."""
    text = " ".join(f"w{i % 37} x{i % 11}" for i in range(400))
    docs = spark.createDataFrame([(i, text if i % 2 else f"{text} {i}") for i in range(200)], "doc_id long, text string")
    path = scratch_path(spark, "keywords")
    KS.write_index(docs.repartition(7), path, partitions=4)
    asks = spark.createDataFrame([(0, text)], "qid long, text string")
    got = KS.bm25_top_k(spark, path, asks, 50).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(1, 101, 2)) and len({r.score for r in got}) == 1


def test_fusion(spark):
    schema = "qid int, doc_id int, rank int"
    v = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], schema)
    w = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (3, 9, 1)], schema)
    got = [tuple(r) for r in KS.fused(v, w, 2).orderBy("qid", "rank").select("qid", "doc_id", "rank").collect()]
    assert got == [(1, 11, 1), (1, 10, 2), (2, 10, 1), (3, 9, 1)]


CHUNKS = [("d1_chunk_0", "d1", 0, "The red fox", "public", 100), ("d1_chunk_1", "d1", 1, "A hound", "team", 200),
          ("d2_chunk_0", "d2", 0, "RED sea", None, None), ("d3_chunk_0", "d3", 0, None, "public", 300),
          ("d3_chunk_1", "d3", 1, "fox and RED fox", "public", 0)]
CHUNK_SCHEMA = "vector_id string, doc_id string, chunk_id int, summary string, acl string, ts long"


def test_chunk_filters(spark):
    df = spark.createDataFrame(CHUNKS, CHUNK_SCHEMA)
    ids = lambda d: sorted(r.vector_id for r in d.collect())
    assert ids(filters.matching(df, "Red")) == ["d1_chunk_0", "d2_chunk_0", "d3_chunk_1"]
    assert ids(filters.matching(df, acl="public")) == ["d1_chunk_0", "d3_chunk_0", "d3_chunk_1"]
    assert ids(filters.matching(df, min_time=100)) == ["d1_chunk_0", "d1_chunk_1", "d3_chunk_0"]
    assert ids(filters.matching(df, max_time=100)) == ["d1_chunk_0", "d2_chunk_0", "d3_chunk_1"]
    assert len(ids(filters.matching(df, "", "", 0, 0))) == 5  # falsy means no filter
    assert ids(filters.of_documents(df, ["d1"])) == ["d1_chunk_0", "d1_chunk_1"]


KEYWORD_ASKS = [(0, "red", None, 0, 0), (1, "FOX", "public", 50, None), (2, "", "team", None, None),
                (3, "zzz", None, None, None), (4, "a", "", 0, 150), (5, None, "public", 0, 0)]
ASK_SCHEMA = "qid int, keyword string, acl string, min_time long, max_time long"


@pytest.mark.parametrize("options", [{}, {"block_rows": 2}, {"block_bytes": 60}])
def test_many_keyword_queries(spark, plan, options):
    df = spark.createDataFrame(CHUNKS, CHUNK_SCHEMA).repartition(3)
    queries = spark.createDataFrame(KEYWORD_ASKS, ASK_SCHEMA)
    want = {(a[0], r.vector_id) for a in KEYWORD_ASKS for r in filters.matching(df, *a[1:]).collect()}
    found = filters.matching_queries(df, queries, carry=("vector_id",), **options)
    assert {(r.qid, r.vector_id) for r in found.collect()} == want and found.count() == len(want)
    assert "hashpartitioning" not in plan(found)  # no text is moved to meet a query
    first = filters.matching_queries(df.coalesce(1), queries, carry=("vector_id",), k=1, **options).collect()
    order = {(a, min((r.doc_id, r.chunk_id) for r in filters.matching(df, *b).collect()))
             for a, *b in KEYWORD_ASKS if any(a == w[0] for w in want)}
    assert {(r.qid, (r.doc_id, r.chunk_id)) for r in first} == order
    assert {(r.qid, r.matched) for r in first} == set(Counter(a for a, _ in want).items())


def test_dispatch(spark):
    vec = {"d1_chunk_0": [1.0, 0.0], "d1_chunk_1": [0.0, 1.0], "d2_chunk_0": [1.0, 1.0], "d3_chunk_0": [0.9, 0.1], "d3_chunk_1": [0.0, 0.0]}
    df = spark.createDataFrame([(*c, vec[c[0]]) for c in CHUNKS], CHUNK_SCHEMA + ", embedding array<double>")
    asks = [(0, "red", None, None, None, None), (1, "red", "public", None, None, [1.0, 0.0]), (2, None, None, None, None, None),
            (3, None, None, None, None, [1.0, 0.0])]
    queries = spark.createDataFrame(asks, "qid int, keyword string, acl string, min_time long, max_time long, embedding array<double>")
    got = {}
    for r in answer.dispatch(df, queries, 3).collect():
        got.setdefault((r.qid, r.branch), {})[r["rank"]] = r.vector_id
    assert got[0, "keyword"] == {1: "d1_chunk_0", 2: "d2_chunk_0", 3: "d3_chunk_1"}
    assert got[3, "vector"] == {1: "d1_chunk_0", 2: "d3_chunk_0", 3: "d2_chunk_0"}
    assert got[1, "vector"] == {1: "d1_chunk_0", 2: "d3_chunk_0"}  # filtered after the three hits
    assert set(got) == {(0, "keyword"), (1, "vector"), (3, "vector")}
    half = answer.dispatch(df, queries, 5, 0.4)
    assert half.where("qid = 0").count() == 1 and half.where("qid = 3").count() == 2


def test_dispatch_without_limits(spark):
    df = spark.createDataFrame([(*c, [float(i), 1.0]) for i, c in enumerate(CHUNKS)], CHUNK_SCHEMA + ", embedding array<double>")
    asks = spark.createDataFrame([(0, "red", None, None, None, None), (3, None, None, None, None, [1.0, 0.0]),
                                  (4, None, "public", None, None, [1.0, 0.0])],
                                 ASK_SCHEMA + ", embedding array<double>")
    for none in (0, None):
        got = answer.dispatch(df, asks, none)
        counts = {r.qid: r["count"] for r in got.groupBy("qid").count().collect()}
        assert counts == {0: 3, 3: 5, 4: 3}
        ranks = sorted(r["rank"] for r in got.where("qid = 3").collect())
        assert ranks == [1, 2, 3, 4, 5]
        assert answer.dispatch(df, asks, none, 0.5).where("qid = 3").count() == 2
    assert answer.dispatch(df, asks.where("qid = 0"), 0).count() == 3  # no request carries a vector


def test_dispatch_without_limits_ranks_every_vector(spark):
    df = spark.range(30).selectExpr("concat('d', id, '_chunk_0') AS vector_id", "concat('d', id) AS doc_id", "0 AS chunk_id",
                                    "'s' AS summary", "'public' AS acl", "0L AS ts", "IF(id = 7, NULL, array(double(id), 1D)) AS embedding")
    asks = spark.createDataFrame([(3, None, None, None, None, [0.0, 1.0])], ASK_SCHEMA + ", embedding array<double>")
    got = {r["rank"]: r.vector_id for r in answer.dispatch(df, asks, 0).collect()}
    assert got == {i + 1: f"d{d}_chunk_0" for i, d in enumerate(d for d in range(30) if d != 7)}


def test_questions_without_hits_keep_a_prompt(spark):
    asks = spark.createDataFrame([(1, "first?"), (2, "second?")], "qid int, text string")
    hits = spark.createDataFrame([(1, 7, 1)], "qid int, doc_id int, rank int")
    texts = spark.createDataFrame([(7, "passage")], "doc_id int, chunk string")
    got = {r.qid: (r.passages, r.prompt) for r in answer.prompts_for(asks, hits, texts, ["doc_id"]).collect()}
    assert got[1][0] == 1 and "passage" in got[1][1] and got[2][0] == 0 and got[2][1].endswith("Question: second?")


def test_blocks_are_bounded(spark):
    df = spark.range(100).withColumn("t", F.repeat(F.lit("x"), 100))
    for options in ({"rows": 10}, {"limit_bytes": 1500}):
        sizes = [b.num_rows for b in topk.blocks_of(df, "id", **options)]
        assert sum(sizes) == 100 and len(sizes) >= 8 and max(sizes) < 30
    assert [b.num_rows for b in topk.blocks_of(df, "id")] == [100]


def test_drift(spark):
    a = spark.createDataFrame([("x", [1.0, 1.0]), ("x", [3.0, 1.0]), ("y", [0.0, 0.0])], "g string, embedding array<double>")
    b = spark.createDataFrame([("x", [5.0, 5.0]), ("y", [0.0, 0.0])], "g string, embedding array<double>")
    assert {tuple(r) for r in quality.embedding_drift(a, b, "g").collect()} == {("x", 5.0), ("y", 0.0)}


def test_null_vectors_are_skipped(spark):
    corpus = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [0.0, 0.1]), (2, None)], "qid int, embedding array<double>")
    hits = VS.vector_top_k(corpus, asked, 5)
    assert sorted((r.qid, r.vec_id) for r in hits.collect()) == [(1, 1), (1, 2)]
    lists = VS.train_lists(corpus, 2)
    assigned = VS.assign_lists(corpus, lists)
    found = VS.probe_top_k(assigned, lists, asked, 5, 2)
    assert sorted((r.qid, r.vec_id) for r in found.collect()) == [(1, 1), (1, 2)]
    assert {r.qid for r in VS.mmr_top_k(corpus, asked).collect()} == {1}
    assert VS.vector_top_k(corpus, asked.where("qid = 2"), 5).count() == 0


def test_lists_are_trained_on_a_bounded_sample(spark):
    corpus = spark.range(4000).select(F.col("id").alias("vec_id"), F.array(
        (F.col("id") % 4 * 10 + F.rand(1)), F.rand(2)).alias("embedding"))
    lists = VS.train_lists(corpus, 4, per_list=50)
    assert sorted(round(r.embedding[0] / 10) for r in lists.collect()) == [0, 1, 2, 3]
