"""Lists trained in two levels, recall by probes, and scans of changed files."""

import os
import weakref

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import vector_search as VS
from docmill.session import staged
from docmill.sources import documents as sources, tables
from docmill.workload import files_and_streams


def test_lists_are_dealt_by_size_within_what_is_distinct():
    assert VS.spread(np.array([90, 30, 10]), np.array([90, 30, 10]), 13).tolist() == [9, 3, 1]
    assert VS.spread(np.array([1000, 5, 5]), np.array([1, 5, 2]), 100).tolist() == [1, 5, 2]  # copies take one list
    assert VS.spread(np.array([4, 4]), np.array([4, 4]), 1).sum() == 2  # a cell always has a list


def test_no_list_stays_empty():
    rng = np.random.default_rng(1)
    x = np.concatenate([np.zeros((500, 3)), rng.normal(size=(40, 3)) + 50, rng.normal(size=(3, 3)) - 90])
    for k in (1, 2, 17, 44):
        centroids = VS.lloyd(x, k, 20, 7)
        own = VS.squared_distances(x, centroids).argmin(axis=1)
        assert len(np.unique(own)) == k


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(30, 8)) * 20, 20, axis=0) + rng.normal(size=(600, 8))
    x[:200] = x[0]  # a third are copies of one vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (None, [float(v) for v in x[300]])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)


def test_two_levels(spark, corpus):
    lists = VS.train_two_levels(corpus, 24)
    rows = lists.orderBy("list_id").collect()
    assert [r.list_id for r in rows] == list(range(24))
    again = VS.train_two_levels(corpus.repartition(3), 24).orderBy("list_id").collect()
    assert len(again) == 24
    used = VS.assign_lists(corpus, lists).where("list_id IS NOT NULL").select("list_id").distinct().count()
    assert used == 24


def test_fewer_distinct_vectors_than_lists(spark, corpus):
    few = corpus.where("vec_id < 203")
    assert VS.train_two_levels(few, 64).count() == few.select("embedding").distinct().count() == 4
    assert VS.train_two_levels(corpus.where("vec_id = 900"), 8).count() == 0
    assert VS.train_two_levels(corpus.limit(0), 8).count() == 0


def test_the_sample_does_not_depend_on_the_partitions(corpus):
    one = VS.hash_sample(corpus, 100, "vec_id", 7)
    two = VS.hash_sample(corpus.repartition(2), 100, "vec_id", 7)
    assert sorted(map(tuple, (r.embedding for r in one.collect()))) == sorted(map(tuple, (r.embedding for r in two.collect())))
    assert 50 < one.count() < 150


def test_measured_recall_is_what_a_search_finds(spark, corpus):
    lists = VS.train_two_levels(corpus, 24)
    assigned = staged(VS.assign_lists(corpus.where("vec_id IS NOT NULL"), lists), "assigned")
    asked = corpus.where("vec_id % 37 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    measured = {r.nprobe: r for r in VS.recall_by_nprobe(assigned, lists, asked, 5).collect()}
    exact = VS.vector_top_k(corpus.where("vec_id IS NOT NULL"), asked, 5)
    best = 0
    for nprobe in range(1, 25, 4):
        best = max([r.matched for n, r in measured.items() if n <= nprobe], default=best)
        found = VS.recall(VS.probe_top_k(assigned, lists, asked, 5, nprobe=nprobe), exact).first()
        assert found.matched == best
    assert max(r.recall for r in measured.values()) == 1
    least = VS.nprobe_for(VS.recall_by_nprobe(assigned, lists, asked, 5), 0.9)
    assert measured[least].recall >= 0.9 and all(r.recall < 0.9 for n, r in measured.items() if n < least)
    assert VS.nprobe_for(VS.recall_by_nprobe(assigned, lists, asked.limit(0), 5)) is None


# ---- files ------------------------------------------------------------------------------


def put(folder, name, text, at):
    (folder / name).write_bytes(text.encode())
    os.utime(folder / name, (at, at))


def files_read(df):
    """Rows, and the number of files that the text scan opened."""
    rows = df.collect()
    def scans(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            return scans(plan.executedPlan())
        if plan.nodeName().endswith("QueryStage"):
            return scans(plan.plan())
        leaves = plan.collectLeaves()
        below = [leaves.apply(i) for i in range(leaves.size())]
        return [s for x in below for s in (scans(x) if x.nodeName().endswith("QueryStage") else [x])]
    found = scans(df._jdf.queryExecution().executedPlan())
    return rows, [s.metrics().apply("numFiles").value() for s in found if s.nodeName().strip() == "Scan text"]


def test_only_changed_files_are_read(spark, tmp_path):
    for i in range(20):
        put(tmp_path, f"doc {i}%.txt", f"text {i}", 1_700_000_000 + i)
    put(tmp_path, "empty.txt", "", 1_700_000_000)
    seen = staged(sources.listed_files(spark, str(tmp_path)), "seen")
    assert seen.count() == 20
    assert sources.file_changes(spark, str(tmp_path), seen).count() == 0
    nothing = staged(sources.file_changes(spark, str(tmp_path), seen), "changes")
    assert sources.changed_documents(spark, str(tmp_path), nothing).count() == 0

    put(tmp_path, "doc 3%.txt", "changed", 1_700_000_100)
    put(tmp_path, "new.txt", "one\r\ntwo", 1_700_000_101)
    (tmp_path / "doc 7%.txt").unlink()
    changes = staged(sources.file_changes(spark, str(tmp_path), seen), "changes")
    assert {(r.path.rsplit("/", 1)[1], r.change) for r in changes.collect()} == {
        ("doc%203%25.txt", "changed"), ("new.txt", "new"), ("doc%207%25.txt", "gone")}
    rows, opened = files_read(sources.changed_documents(spark, str(tmp_path), changes))
    assert {(r.doc_id, r.text) for r in rows} == {("doc 3%", "changed"), ("new", "one\ntwo")}
    assert opened == [2]


def test_ids_are_the_names_of_the_files(spark, tmp_path):
    for name in ("a b+c%41.é.txt", "plain", "x%2By.md"):
        put(tmp_path, name, "text", 1_700_000_000)
    assert {r.doc_id for r in sources.text_documents(spark, str(tmp_path)).collect()} == {"a b+c%41.é", "plain", "x%2By"}
    ids = ["1+1", "50%", "a b", "c:d", "é"]
    folder = str(tmp_path / "written")
    tables.write_text_files(spark.createDataFrame([(i, "text") for i in ids], "doc_id string, text string"), folder)
    assert sorted(r.doc_id for r in sources.text_documents(spark, folder).collect()) == ids


def test_all_lists_of_many_vectors(spark):
    """Vectors and all their lists are more cells than one step of the kernel takes."""
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(3000, 2)), rng.normal(size=(400, 2))
    frame = lambda m, name: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], f"{name} int, embedding array<double>")
    got = VS.with_lists(frame(x, "vec_id").coalesce(1), frame(c, "list_id"), 400).selectExpr("vec_id", "lists.list_id AS l").collect()
    want = VS.squared_distances(x, c).argsort(axis=1)
    assert len(got) == 3000 and all(r.l == want[r.vec_id].tolist() for r in got)


def test_text_files_share_folders_and_tasks(spark, tmp_path):
    folder = str(tmp_path / "written")
    rows = [(str(i), f"text {i}") for i in range(3000)] + [("7", "again"), (None, "no id"), ("null text", None)]
    tables.write_text_files(spark.createDataFrame(rows, "doc_id string, text string"), folder)
    assert len(list((tmp_path / "written").iterdir())) <= tables.FILE_FOLDERS  # and no folder a document
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    with sources.small_files(spark):
        assert sources.text_documents(spark, folder).rdd.getNumPartitions() < 64
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    got = {r.doc_id: r.text for r in sources.text_documents(spark, folder).collect()}
    assert len(got) == 3002 and got["7"] == "again\ntext 7\n" and got["null text"] == "\n" and got[tables.NO_ID] == "no id\n"
    with pytest.raises(FileExistsError):
        tables.write_text_files(spark.createDataFrame(rows, "doc_id string, text string"), folder)
    tables.write_text_files(spark.createDataFrame([("7", "new")], "doc_id string, text string"), folder, replace=True)
    got = {r.doc_id: r.text for r in sources.text_documents(spark, folder).collect()}
    assert len(got) == 3002 and got["7"] == "new\n" and got["8"] == "text 8\n"


def test_an_older_file_put_back_is_a_change(spark, tmp_path):
    for i in range(10):
        put(tmp_path, f"{i}.txt", f"text {i}", 1_700_000_000 + i)
    seen = staged(sources.listed_files(spark, str(tmp_path)), "seen")
    put(tmp_path, "9.txt", "restored", 1_700_000_004)  # now as old as another one, which has not changed
    changes = staged(sources.file_changes(spark, str(tmp_path), seen), "changes")
    rows, opened = files_read(sources.changed_documents(spark, str(tmp_path), changes))
    assert [(r.doc_id, r.text) for r in rows] == [("9", "restored")] and opened == [2]


def test_the_first_scan_reads_all(spark, tmp_path):
    for i in range(5):
        put(tmp_path, f"{i}.txt", f"text {i}", 1_700_000_000)
    none = spark.createDataFrame([], "path string, last_modified timestamp")
    changes = staged(sources.file_changes(spark, str(tmp_path), none), "changes")
    assert sources.changed_documents(spark, str(tmp_path), changes).count() == 5


def test_files_of_many_folders_are_listed_in_parts(spark, tmp_path, monkeypatch):
    """The driver lists some of the folders at a time, and the rows are those of a scan of all."""
    folder, ids = str(tmp_path / "wri tten é"), [f"d {i}" for i in range(200)]
    tables.write_text_files(spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id string, text string"), folder)
    (tmp_path / "wri tten é" / "_hidden").mkdir()
    assert sources.parts(spark, folder) == [] == sources.parts(spark, str(tmp_path)) == sources.parts(spark, f"{folder}/*")
    monkeypatch.setattr(sources, "FILES_AT_ONCE", 50)
    kept = [spark.conf.get(name) for name in sources.SMALL_FILES]
    listed, real = [], sources.text_documents

    def told(session, some):
        docs = real(session, some)
        listed.append(len(docs.inputFiles()))
        return docs
    monkeypatch.setattr(sources, "text_documents", told)
    seen = sources.listed_files(spark, folder)
    assert seen.count() == 200 and seen.distinct().count() == 200
    got = sources.scanned(spark, folder, "scanned", lambda some: sources.text_documents(spark, some).select("doc_id", "text", "path"))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted((i, f"text {i}\n") for i in ids)
    assert sum(listed) == 200 and max(listed) <= 50 and len(listed) >= 4
    assert {r.path for r in got.collect()} == {r.path for r in seen.collect()}

    again = spark.createDataFrame([("d 3", "new"), ("d 77", "new"), ("more", "more")], "doc_id string, text string")
    tables.write_text_files(again, folder, replace=True)
    changes = staged(sources.file_changes(spark, folder, seen), "changes")
    assert sorted(r.change for r in changes.collect()) == ["changed", "changed", "new"]
    listed.clear()
    rows = sources.changed_documents(spark, folder, changes, lambda docs: docs.select("doc_id", F.upper("text").alias("t"))).collect()
    assert sorted((r.doc_id, r.t) for r in rows) == [("d 3", "NEW\n"), ("d 77", "NEW\n"), ("more", "MORE\n")]
    assert sum(listed) == 201 and max(listed) <= 50
    assert [spark.conf.get(name) for name in sources.SMALL_FILES] == kept
    nothing = staged(sources.file_changes(spark, folder, sources.listed_files(spark, folder)), "changes")
    assert sources.changed_documents(spark, folder, nothing).count() == 0


@pytest.mark.parametrize("name", ["incremental_scan", "text_file_scan"])
def test_file_queries_list_in_parts(spark, tmp_path, monkeypatch, name):
    spark.range(300).select(F.col("id").alias("doc_id"), F.format_string("text %d", "id").alias("text"), F.lit("en").alias("lang"),
                            F.lit("src1").alias("source"), F.lit(9).alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(150).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    query = getattr(files_and_streams, name)
    whole, listed, real = sorted(map(tuple, query(spark, str(tmp_path)).collect())), [], sources.text_documents

    def told(session, some):
        assert not held or held[-1]() is None  # the part before, with its list
        docs = real(session, some)
        held.append(weakref.ref(docs._jdf))
        listed.append(len(docs.inputFiles()))
        return docs
    held = []
    monkeypatch.setattr(sources, "FILES_AT_ONCE", 60)
    monkeypatch.setattr(sources, "text_documents", told)
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == whole
    assert len(whole) == {"incremental_scan": 75, "text_file_scan": 300}[name]
    assert sum(listed) == 300 and max(listed) <= 60
