"""Tag, phrase and proximity indexes, bucketed tables and the evaluation log against plain Python."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from docmill.operators import block_index, evaluation_log, keyword_search, phrase_index, tag_index
from docmill.session import BATCH_LIMITS, scratch_path, small_batches
from docmill.sources import bucketed

TOKEN = re.compile(r"[^\W]+")


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# ---- tags -------------------------------------------------------------------------------

TAGGED = [(1, ["a", "b"]), (2, ["b", "b", None, ""]), (3, []), (4, None), (0, ["a"]), (-5, ["c", "a"]), (32768, ["a", "c"]),
          (32769, ["b", "c"]), (10**12, ["a", "b", "c"]), (2, ["d"]), (None, ["a", "d"])]


@pytest.fixture(scope="module")
def tags(spark):
    path = scratch_path(spark, "tags")
    tag_index.write_tag_index(spark.createDataFrame(TAGGED, "doc_id long, keywords array<string>"), path, partitions=4)
    return path


@pytest.mark.parametrize("asked", [(["a"], None, None), (["a", "d"], None, None), (None, ["a", "b"], None), (None, None, ["b"]),
                                   (["a", "c"], ["c"], ["b"]), (None, None, None), (["zzz"], None, None), (None, ["a", "zzz"], None),
                                   (None, None, ["zzz"]), (["a"], ["d"], None), (["a"], ["a"], ["a"])])
def test_tags(spark, tags, asked):
    held = {}
    for doc, own in TAGGED:
        if doc is not None:
            held.setdefault(doc, set()).update(t for t in own or [] if t)
    any_of, all_of, none_of = (set(x or []) for x in asked)
    want = [d for d, own in held.items() if (not any_of or own & any_of) and all_of <= own and not own & none_of]
    assert pairs(tag_index.with_tags(spark, tags, *asked), "doc_id") == sorted((d,) for d in want)


def test_tags_read_only_their_partitions(spark, tags, plan):
    text = plan(tag_index.with_tags(spark, tags, ["a"]))
    assert re.search(r"PartitionFilters: \[.*part#", text) and "keywords" not in text


def test_the_empty_tag_is_refused(spark, tags):
    with pytest.raises(ValueError):
        tag_index.with_tags(spark, tags, [""])


# ---- phrases ----------------------------------------------------------------------------

rng = random.Random(2)
DOCS = [(1, "red fox, Red FOX red"), (2, "fox red"), (3, None), (4, ""), (5, "a a a a"), (6, "red big fox"), (7, "... red\nfox!"),
        (8, "red " * 500 + "fox"), *[(i, " ".join(rng.choices("abcd", k=rng.randrange(30)))) for i in range(10, 60)]]
ASKED = [(1, "red fox"), (2, "fox red"), (3, "a a"), (4, "missing"), (5, ""), (6, None), (7, "a b a"), (8, "RED"), (9, "b c"), (10, "d d d a")]


def tokens(text):
    return TOKEN.findall((text or "").lower())


@pytest.fixture(scope="module")
def positions(spark):
    path = scratch_path(spark, "positions")
    phrase_index.write_positions(spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3), path, partitions=4)
    return path


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "qid int, text string")


def test_phrases(spark, positions, asked):
    want = []
    for qid, phrase in ASKED:
        p = tokens(phrase)
        for doc, text in DOCS:
            w = tokens(text)
            places = [i for i in range(len(w) - len(p) + 1) if p and w[i:i + len(p)] == p]
            want += [(qid, doc, len(places), places[0])] if places else []
    assert pairs(phrase_index.phrase_hits(spark, positions, asked), "qid", "doc_id", "n_places", "first") == sorted(want)


@pytest.mark.parametrize("within", [1, 2, 4, 100])
def test_proximity(spark, positions, asked, within):
    want = []
    for qid, text in ASKED:
        words = set(tokens(text))
        for doc, own in DOCS:
            w = tokens(own)
            spans = [(j - i + 1, i) for i in range(len(w)) for j in range(i, min(len(w), i + within))
                     if words and words <= set(w[i:j + 1])] if words <= set(w) else []
            want += [(qid, doc, *min(spans))] if spans else []
    assert pairs(phrase_index.proximity_hits(spark, positions, asked, within), "qid", "doc_id", "span", "first") == sorted(want)


def test_phrases_read_no_text(spark, positions, asked, plan):
    text = plan(phrase_index.phrase_hits(spark, positions, asked))
    assert re.search(r"PartitionFilters: \[.*part#", text) and "MapInArrow" not in text
    assert phrase_index.phrase_hits(spark, positions, asked.limit(0)).count() == 0


# ---- bucketed tables --------------------------------------------------------------------


def test_bucketed_tables(spark, plan):
    names = [f"t_{uuid.uuid4().hex}" for _ in range(2)]
    chunks = spark.range(300).select((F.col("id") % 40).alias("doc_id"), F.col("id").cast("int").alias("chunk_id"))
    bucketed.write_bucketed(chunks, names[0], scratch_path(spark, "chunks"), 8)
    bucketed.write_bucketed(chunks.where("doc_id % 3 = 0 or chunk_id < 40").where("doc_id < 35"), names[1], scratch_path(spark, "state"), 8)
    some = bucketed.chunks_by_ids(spark, names[0], [3])
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not name the buckets
    assert "SelectedBucketsCount: 1 out of 8" in plan(bucketed.chunks_by_ids(spark, names[0], [3]))
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert pairs(some, "chunk_id") == [(i,) for i in range(3, 300, 40)]
    missing = bucketed.missing_rows(spark.table(names[0]), spark.table(names[1]))
    held = {(i % 40, i) for i in range(300) if (i % 40 % 3 == 0 or i < 40) and i % 40 < 35}
    assert pairs(missing, "doc_id", "chunk_id") == sorted({(i % 40, i) for i in range(300)} - held)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(bucketed.missing_rows(spark.table(names[0]), spark.table(names[1])))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"DROP TABLE {name}")


# ---- evaluation log ---------------------------------------------------------------------


def test_evaluation_log(spark):
    scores = spark.range(40_000).select((F.col("id") % 700).alias("doc_id"), (F.col("id") / 40_000).alias("score"),
                                        F.when(F.col("id") % 4 == 0, "g").alias("part"))
    path = scratch_path(spark, "log")
    evaluation_log.append_run(scores, path, "first", "part")
    evaluation_log.append_run(scores.withColumn("score", F.col("score") / 2), path, "second", "part")
    evaluation_log.append_run(scores, path, "first", "part")  # once more: replaces
    evaluation_log.append_run(scores.withColumn("score", F.lit(None).cast("double")), path, "none")
    log = evaluation_log.runs(spark, path)
    told = {r.run: r for r in evaluation_log.summary(log).collect()}
    assert set(told) == {"first", "second"}
    first = told["first"]
    assert first.chunks == 40_000 and abs(first.mean_score - 0.4999875) < 1e-9 and first.low_share == 0.5
    assert abs(first.q50 - 0.5) < 2 * evaluation_log.RANK_ERROR and abs(first.q90 - 0.9) < 2 * evaluation_log.RANK_ERROR
    assert abs(first.n_documents / 700 - 1) < 0.05
    drift = {r["group"]: r.drift for r in evaluation_log.score_drift(log, "first", "second").collect()}
    assert set(drift) == {"", "g"} and all(abs(d - 0.475) < 0.03 for d in drift.values())
    assert all(r.drift < 0.01 for r in evaluation_log.score_drift(log, "first", "first").collect())
    assert evaluation_log.summary(log, "group").count() == 2


def test_indexes_hand_small_batches_to_python(spark, tmp_path, monkeypatch):
    """Also of many rows, and of few with many words; the session's own limits come back."""
    seen = str(tmp_path / "seen")
    before = {n: spark.conf.get(n) for n in BATCH_LIMITS}
    for module, write in ((keyword_search, keyword_search.write_index), (block_index, block_index.write_index),
                          (phrase_index, phrase_index.write_positions)):
        def told(batches, column, most=1 << 18, plain=keyword_search.bounded, name=f"{seen}-{module.__name__}"):
            for batch in batches:
                with open(name, "a") as f:
                    f.write(f"{batch.num_rows} {batch.nbytes}\n")
                yield from plain(iter([batch]), column, most)
        with monkeypatch.context() as m:
            m.setattr(keyword_search if module is block_index else module, "bounded", told)
            docs = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), F.when(
                F.col("id") < 3000, "few words").otherwise(F.repeat(F.lit("many words "), 1000)).alias("text"))
            write(docs, str(tmp_path / module.__name__), partitions=2)
        sizes = [tuple(map(int, line.split())) for line in open(f"{seen}-{module.__name__}")]
        assert sum(n for n, _ in sizes) == 5000 and max(n for n, _ in sizes) <= 1000
        assert max(b for _, b in sizes) < 16 << 20
        assert {n: spark.conf.get(n) for n in BATCH_LIMITS} == before
    with pytest.raises(RuntimeError), small_batches(spark):
        raise RuntimeError
    assert {n: spark.conf.get(n) for n in BATCH_LIMITS} == before
