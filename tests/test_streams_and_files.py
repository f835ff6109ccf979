"""Files, sinks and streams."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docmill.functions.text import BLANK_LINE
from docmill.session import scratch_path, staged, workspace
from docmill.sources import documents as sources, tables
from docmill.streaming import ingest as stream, memory


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo", encoding="utf-8")
    (tmp_path / "b.c.txt").write_bytes("é\r\n\r\nx".encode())
    (tmp_path / "empty.txt").write_text("", encoding="utf-8")
    rows = {r.doc_id: r for r in sources.text_documents(spark, str(tmp_path)).collect()}
    assert rows["a"].text == "one\n\ntwo" and rows["b.c"].text == "é\n\nx" and rows["a"].storage == "local"
    assert set(rows) == {"a", "b.c"}
    assert abs(rows["a"].last_modified.timestamp() - (tmp_path / "a.txt").stat().st_mtime) < 1


def test_storage_names(spark):
    df = spark.createDataFrame([("s3a://b/x",), ("abfss://c/x",), ("file:/x",)], "p string")
    assert [r[0] for r in df.select(sources.storage_of(F.col("p"))).collect()] == ["s3", "azure", "local"]


def test_id_list(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" 1 \n\n\u00a02\t\n   \n9\n", encoding="utf-8")
    ids = sources.id_list(spark, str(tmp_path / "ids.txt"))
    assert sorted(r.doc_id for r in ids.collect()) == ["1", "2", "9"]
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    assert sorted(r.doc_id for r in sources.listed(docs, ids).collect()) == [1, 2]


def test_upload_gives_new_ids(spark):
    path = scratch_path(spark, "up")
    docs = spark.createDataFrame([("a", "s3"), ("b", None)], "text string, storage string")
    tables.upload(docs, path)
    back = tables.upload(docs, path).collect()
    assert len({r.doc_id for r in back}) == 4 and {r.storage for r in back} == {"s3", "local"}


def test_summary_file_is_in_order(spark):
    path = scratch_path(spark, "sum")
    rows = [(d, c, f"{d}-{c}" if c != 2 else "") for d in range(3) for c in range(4)]
    tables.write_summaries(spark.createDataFrame(rows, "doc_id int, chunk_id int, summary string").repartition(4), path)
    texts = spark.read.text(path, wholetext=True).withColumn("f", F.input_file_name()).orderBy("f").collect()
    joined = "".join(t.value for t in texts).strip()
    assert joined == BLANK_LINE.join(s for _, _, s in rows if s)


def docs(n, text="alpha. beta\n\ngamma"):
    return pd.DataFrame({"doc_id": range(n), "text": [f"{text} {i}" for i in range(n)]})


def test_ingest_stream_is_idempotent(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    docs(3).to_parquet(folder / "documents-1.parquet")
    paths = [scratch_path(spark, n) for n in ("i", "s", "a")]

    def go(checkpoint):
        source = stream.table_stream(spark, str(folder), "documents", "doc_id long, text string")
        stream.start(source, *paths, checkpoint, 1, min_chars=None, strategy="paragraph_clean").awaitTermination()
        return sorted((r.vector_id, r.summary) for r in tables.read_batches(spark, paths[0], "doc_id").collect())

    checkpoint = scratch_path(spark, "c")
    first = go(checkpoint)
    assert [v for v, _ in first] == [f"{d}_chunk_{c}" for d in range(3) for c in range(2)]
    assert go(checkpoint) == first
    assert go(scratch_path(spark, "c")) == first  # batch 0 once more, as after a lost commit
    assert spark.read.parquet(paths[0]).count() == len(first)
    assert spark.read.parquet(paths[2]).count() == 3
    docs(4, "alpha. new").to_parquet(folder / "documents-2.parquet")
    after = go(checkpoint)
    assert after == [(f"{d}_chunk_0", f"alpha. new {d}") for d in range(4)]  # and no old second chunk
    assert tables.read_batches(spark, paths[1], "doc_id").count() == 4


def test_a_table_that_is_a_folder_streams_too(spark, tmp_path):
    (tmp_path / "documents.parquet").mkdir()
    for n in range(2):
        docs(2).assign(doc_id=[2 * n, 2 * n + 1]).to_parquet(tmp_path / "documents.parquet" / f"part-{n}.parquet")
    docs(1).to_parquet(tmp_path / "others.parquet")
    source = stream.table_stream(spark, str(tmp_path), "documents", "doc_id long, text string")
    paths = [scratch_path(spark, n) for n in ("i", "s", "a", "c")]
    stream.start(source, *paths, 1, min_chars=None).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(paths[2]).collect()) == ["0", "1", "2", "3"]
    docs(1).assign(doc_id=9).to_parquet(tmp_path / "documents.parquet" / "part-2.parquet")
    stream.start(source, *paths, 1, min_chars=None).awaitTermination()
    assert spark.read.parquet(paths[2]).count() == 5


def test_a_document_that_fails_the_gate_later_leaves_the_index(spark, tmp_path):
    paths, checkpoint = [scratch_path(spark, n) for n in ("i", "s", "a")], scratch_path(spark, "c")

    def feed(name, rows):
        pd.DataFrame(rows, columns=["doc_id", "text"]).to_parquet(tmp_path / f"documents-{name}.parquet")
        source = stream.table_stream(spark, str(tmp_path), "documents", "doc_id long, text string")
        stream.start(source, *paths, checkpoint, min_chars=5, strategy="paragraph_clean").awaitTermination()
        rows = tables.read_batches(spark, paths[0], "doc_id").collect()
        return sorted(r.vector_id for r in rows), {r.ts for r in rows}

    first, times = feed("1", [(1, "long enough"), (2, "also long enough")])
    assert first == ["1_chunk_0", "2_chunk_0"] and min(times) > 1_700_000_000  # the time of the batch
    assert feed("2", [(1, "no")])[0] == ["2_chunk_0"]
    assert {r.doc_id for r in tables.read_batches(spark, paths[1], "doc_id").collect()} == {2}


def test_trigger_can_be_chosen(spark, tmp_path):
    docs(2).to_parquet(tmp_path / "documents-1.parquet")
    source = stream.table_stream(spark, str(tmp_path), "documents", "doc_id long, text string")
    paths = [scratch_path(spark, n) for n in ("i", "s", "a", "c")]
    run = stream.start(source, *paths, 1, {"processingTime": "1 second"}, min_chars=None)
    try:
        run.processAllAvailable()
        assert run.isActive and tables.read_batches(spark, paths[0], "doc_id").count() > 0
    finally:
        run.stop()


def test_memory_of_named_sessions(spark, tmp_path):
    path, checkpoint = scratch_path(spark, "m"), scratch_path(spark, "c")
    pd.DataFrame([("s1", i, "user", f"m{i}") for i in range(4)] + [("s2", 0, "user", "x")],
                 columns=["session_id", "seq", "role", "content"]).to_parquet(tmp_path / "a.parquet")
    source = spark.readStream.schema("session_id string, seq long, role string, content string").parquet(str(tmp_path))
    with memory.rocksdb(spark):
        memory.start_memory(source, path, checkpoint, 2).awaitTermination()
    got = tables.read_batches(spark, path, "session_id").collect()
    assert sorted((r.session_id, r.position, r.content) for r in got) == [("s1", 1, "m2"), ("s1", 2, "m3"), ("s2", 1, "x")]


def test_the_shared_folder_is_required(spark, monkeypatch):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, name, default=None):
            return self.value

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

    for value, message in ((None, "is not set"), ("file:///tmp/x", "on one machine")):
        Session.conf = Conf(value)
        with pytest.raises(ValueError, match=message):
            scratch_path(Session, "x")


def test_a_workspace_drops_what_was_staged_in_it(spark):
    kept = staged(spark.range(3), "kept")
    with workspace(spark) as path:
        inside = staged(spark.range(5), "inside")
        assert tables.exists(spark, path) and path.rsplit("/", 1)[1] in inside.inputFiles()[0]
        assert inside.count() == 5
    assert not tables.exists(spark, path) and kept.count() == 3


def test_text_stream(spark, tmp_path):
    (tmp_path / "d1.txt").write_text("line one\n\nline two", encoding="utf-8")
    paths = [scratch_path(spark, n) for n in ("i", "s", "a", "c")]
    stream.start(stream.text_stream(spark, str(tmp_path)), *paths, 1, min_chars=None,
                 strategy="paragraph_clean").awaitTermination()
    assert sorted((r.vector_id, r.chunk) for r in tables.read_batches(spark, paths[0], "doc_id").collect()) == [
        ("d1_chunk_0", "line one"), ("d1_chunk_1", "line two")]


def test_status_stream(spark, tmp_path):
    schema = "doc_id long, status string, ts long, seq long"
    path, checkpoint = scratch_path(spark, "st"), scratch_path(spark, "c")

    def feed(name, rows):
        pd.DataFrame(rows, columns=["doc_id", "status", "ts", "seq"]).to_parquet(tmp_path / f"{name}.parquet")
        events = spark.readStream.schema(schema).parquet(str(tmp_path))
        stream.start_status(events, path, checkpoint).awaitTermination()
        return {(r.doc_id, r.status) for r in tables.read_batches(spark, path, "doc_id").collect()}

    assert feed("a", [(1, "start", 1, 1), (1, "complete", 2, 2), (2, "start", 1, 3)]) == {(1, "complete"), (2, "start")}
    assert feed("b", [(2, "fail", 1, 4), (1, "start", 0, 5)]) == {(1, "complete"), (2, "fail")}


def test_memory_over_several_batches(spark, tmp_path):
    path, checkpoint = scratch_path(spark, "m"), scratch_path(spark, "c")

    def feed(name, rows):
        pd.DataFrame(rows, columns=["session_id", "seq", "role", "content"]).to_parquet(tmp_path / f"{name}.parquet")
        source = spark.readStream.schema("session_id long, seq long, role string, content string").parquet(str(tmp_path))
        with memory.rocksdb(spark):
            memory.start_memory(source, path, checkpoint, 3).awaitTermination()
        return sorted((r.session_id, r.position, r.content)
                      for r in tables.read_batches(spark, path, "session_id").collect())

    assert feed("a", [(1, i, "user", f"m{i}") for i in (3, 0, 4, 1, 2)] + [(2, 0, "user", "x")]) == [
        (1, 1, "m2"), (1, 2, "m3"), (1, 3, "m4"), (2, 1, "x")]
    assert feed("b", [(1, 5, "user", "m5"), (2, 1, "user", "y")]) == [
        (1, 1, "m3"), (1, 2, "m4"), (1, 3, "m5"), (2, 1, "x"), (2, 2, "y")]
    with pytest.raises(ValueError):
        memory.LastMessages(0)


def test_memory_of_messages_without_a_number(spark, tmp_path):
    path, checkpoint = scratch_path(spark, "m"), scratch_path(spark, "c")
    big = 2 ** 53

    def feed(name, rows):
        spark.createDataFrame(rows, "session_id long, seq long, role string, content string").coalesce(1).write.parquet(
            str(tmp_path / name))
        source = spark.readStream.schema("session_id long, seq long, role string, content string").parquet(
            f"{tmp_path}/{name[0]}*")
        with memory.rocksdb(spark):
            memory.start_memory(source, path, checkpoint, 3).awaitTermination()
        return sorted((r.session_id, r.position, r.seq, r.content)
                      for r in tables.read_batches(spark, path, "session_id").collect())

    # they are the oldest, and shown behind the others; numbers beside them stay exact
    assert feed("m1", [(1, None, "user", "x"), (1, big + 1, "user", "b"), (1, big, "user", "a"),
                       (2, None, "user", "y"), (2, None, None, "y"), (3, 0, "user", None)]) == [
        (1, 1, big, "a"), (1, 2, big + 1, "b"), (1, 3, None, "x"), (2, 1, None, "y"), (2, 2, None, "y"), (3, 1, 0, None)]
    assert [r[1:] for r in feed("m2", [(1, None, "user", "z"), (1, 1, "user", "c")]) if r[0] == 1] == [
        (1, 1, "c"), (2, big, "a"), (3, big + 1, "b")]
