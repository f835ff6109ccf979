"""The pipeline: every stage against a brute-force version of it, on what its predecessor kept."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
import corpus_pipeline
from docmill.llm import quality_model
from docmill.llm.queries import ORACLES, QUERIES
import test_decontamination as contamination
import test_line_dedup as lines
import test_simhash as near

NAMES = ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]


@pytest.fixture(scope="module")
def stages(spark, small):
    """The rows that go into the first stage and come out of each."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, small), "stage")
        out.append(docs)
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_order_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    assert all(df.schema == stages[0].schema for df in stages[1:5])


def test_quality_stage(spark, small, stages):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = quality_model.train(stages[0], labels)
    kept = [r for r in rows(stages[0]) if model.score(np.array([quality_model.features(r[1])]))[0] >= 0.5]
    assert rows(stages[1]) == kept and len(kept) < stages[0].count()
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good & {r[0] for r in kept}) >= 0.9 * len(good)  # fitted on some fifty rows of this size


def test_line_stage(stages):
    want = {d: t for d, t, _, _ in lines.brute([(r.doc_id, r.text) for r in stages[1].collect()])}
    assert {r.doc_id: r.text for r in stages[2].collect()} == want
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_near_duplicate_stage(stages):
    before = sorted((r.doc_id, near.brute_fingerprint(r.text)) for r in stages[2].collect())
    roots = near.brute_components([fp for _, fp in before])
    assert {r.doc_id for r in stages[3].collect()} == {before[r][0] for r in roots}
    assert stages[3].count() < len(before)


def test_decontamination_stage(spark, small, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    found = contamination.brute([(r.doc_id, r.text) for r in stages[3].collect()], items)
    assert {r.doc_id for r in stages[4].collect()} == {f[0] for f in found if not f[4]}
    assert any(f[4] for f in found)


def test_run_packs_all_that_is_left(spark, small, stages):
    packed = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in stages[4].collect()}
    sizes = packed.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in sizes)


def test_empty_and_odd_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, None),
                                 (None, "text without an id", "en", "s", 1), (2, "", None, None, None)], docs.schema)
    for rows_in in (docs.limit(0), odd):
        step = rows_in
        for _, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, small)
            assert step.schema == docs.schema
        assert corpus_pipeline.STAGES[-1][1](spark, step, small).count() >= 0


CLASHING = ["line_hash_version", "lines_gone", "kept", "row", "fp", "_fp", "root", "n", "a.b", "x`y", "score", "spans", "line1"]


def test_stages_keep_columns_of_any_name(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    own = [F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string")).alias(c) for i, c in enumerate(CLASHING)]
    step = wide = docs.select("*", *own)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, small)
        assert step.columns == wide.columns
        for row in step.collect():
            assert [row[c] for c in CLASHING] == [f"{i}-{row['doc_id']}" for i in range(len(CLASHING))]
    assert corpus_pipeline.STAGES[-1][1](spark, step, small).count() > 0


def test_very_long_white_space_goes_through(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    blank = spark.createDataFrame([(10**9 + i, c * 1_200_000, "en", "s", 1_200_000) for i, c in enumerate(" \t\n\xa0")], docs.schema)
    step = blank
    for _, stage in corpus_pipeline.STAGES[1:]:
        step = stage(spark, step, small)
    assert step.count() > 0


def test_registration():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))
    assert names["pipeline"] is corpus_pipeline.run
    assert set(ORACLES) <= set(QUERIES) <= set(names)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    ok, note = check.compare(spark, check.database(small), small, name)
    assert ok, note
