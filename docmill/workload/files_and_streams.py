"""Files, sinks and streams, driven by the given tables through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.session import scratch_path, staged
from docmill.sources import documents as sources, tables
from docmill.streaming import ingest as stream, memory, state
from docmill.workload.fixtures import LINES, NL, NOW, SQL_SENTENCES, documents, line_chunks, table
from docmill.workload.flows import FIRST_SENTENCE
from docmill.workload.indexing import STATUS
from docmill.workload.registry import query


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text || chr(10)) AS digest, 'local' AS storage, TRUE AS dated
FROM documents""")
def text_file_scan(spark, sf):
    """Documents as text files, scanned back whole with id, storage and modification time."""
    path = scratch_path(spark, "files")
    tables.write_text_files(documents(spark, sf), path)

    def scan(some):
        docs = sources.with_modified(sources.text_documents(spark, some))
        return docs.select("doc_id", F.md5("text").alias("digest"), "storage", F.col("last_modified_iso").rlike(
            r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d").alias("dated"))

    return sources.scanned(spark, path, "scanned", scan)


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text || '!' || chr(10)) AS digest, TRUE AS replaced
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def incremental_scan(spark, sf):
    """Documents as text files; those of low quality are written again, and a second scan reads these alone."""
    path = scratch_path(spark, "files")
    docs = documents(spark, sf).select("doc_id", "text")
    tables.write_text_files(docs, path)
    seen = sources.listed_files(spark, path)
    again = docs.join(table(spark, sf, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    tables.write_text_files(again.withColumn("text", F.concat("text", F.lit("!"))), path, replace=True)
    changes = staged(sources.file_changes(spark, path, seen), "changes")
    old = changes.where("change = 'changed'").select(
        sources.unescaped(sources.unescaped(sources.escaped_id(F.col("path")))).alias("doc_id"),
        F.lit(True).alias("replaced")).distinct()
    with sources.small_files(spark):
        found = sources.changed_documents(spark, path, changes, lambda docs: docs.select("doc_id", F.md5("text").alias("digest")))
        return staged(found.join(old, "doc_id", "left"), "found")


@query("""SELECT md5(text) AS digest, CASE WHEN lang = 'en' THEN 's3' WHEN lang = 'fr' THEN 'azure' ELSE 'local' END AS storage,
  CAST(36 AS INTEGER) AS id_size FROM documents""")
def upload_documents(spark, sf):
    """Append documents under new ids, split by storage."""
    kind = F.when(F.col("lang") == "en", "s3").when(F.col("lang") == "fr", "azure")
    rows = documents(spark, sf).select("text", kind.alias("storage"))
    stored = tables.upload(rows, scratch_path(spark, "uploads"))
    return stored.select(F.md5("text").alias("digest"), "storage", F.length("doc_id").alias("id_size"))


@query("SELECT doc_id, lang, md5(text) AS digest FROM documents")
def table_scan(spark, sf):
    """A table source in another format."""
    path = scratch_path(spark, "orc")
    documents(spark, sf).select("doc_id", "lang", "text").write.orc(path)
    return sources.table_documents(spark, path, "orc").select("doc_id", "lang", F.md5("text").alias("digest"))


@query(f"""WITH {LINES} SELECT md5(s) AS digest FROM (SELECT {SQL_SENTENCES.format('chunk')}[1] AS s FROM lines) WHERE s <> ''""")
def summary_files(spark, sf):
    """Summaries written as text with blank lines between, and read back."""
    path = scratch_path(spark, "summaries")
    tables.write_summaries(line_chunks(spark, sf).withColumn("summary", T.lead(F.col("chunk"), 1)), path)
    return spark.read.option("lineSep", T.BLANK_LINE).text(path).select(F.md5("value").alias("digest"))


def _ingest_stream(spark, sf):
    folder = {n: scratch_path(spark, n) for n in ("index", "state", "audit", "checkpoint")}
    schema = table(spark, sf, "documents").schema
    docs = stream.table_stream(spark, sf, "documents", schema)
    run = stream.start(docs, folder["index"], folder["state"], folder["audit"], folder["checkpoint"], NOW,
                       strategy="paragraph_clean", options={"sep": NL}, summarizer=FIRST_SENTENCE)
    run.awaitTermination()
    return folder


STREAMED = f"""WITH {LINES} SELECT {{}} FROM lines WHERE n_chars >= 100"""


@query(STREAMED.format(f"doc_id || '_chunk_' || chunk_id AS vector_id, {SQL_SENTENCES.format('chunk')}[1] AS summary"))
def ingest_stream(spark, sf):
    """The documents as a stream into the index table."""
    return tables.read_batches(spark, _ingest_stream(spark, sf)["index"], "doc_id").select("vector_id", "summary")


@query(STREAMED.format("doc_id, chunk_id, 'unknown' AS version, sha256(chunk) AS chunk_hash"))
def state_stream(spark, sf):
    """The state that the ingest stream keeps."""
    return tables.read_batches(spark, _ingest_stream(spark, sf)["state"], "doc_id")


@query(STREAMED.format("DISTINCT 'indexed' AS event, CAST(doc_id AS VARCHAR) AS doc_id"))
def audit_stream(spark, sf):
    """The audit events that the ingest stream appends."""
    return spark.read.parquet(_ingest_stream(spark, sf)["audit"]).select("event", "doc_id")


@query(f"""SELECT user_id AS doc_id, {STATUS} AS status FROM events WHERE {STATUS} IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def status_stream(spark, sf):
    """Latest upload status as a running aggregate."""
    events = stream.table_stream(spark, sf, "events", table(spark, sf, "events").schema)
    rows = events.select(F.col("user_id").alias("doc_id"), F.expr(STATUS).alias("status"), "ts",
                         F.col("event_id").alias("seq")).where("status is not null")
    path = scratch_path(spark, "status")
    stream.start_status(rows, path, scratch_path(spark, "checkpoint")).awaitTermination()
    return tables.read_batches(spark, path, "doc_id").select("doc_id", "status")


@query("""SELECT session_id, seq, role, content, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS INTEGER) AS position
FROM (SELECT conv_id AS session_id, turn AS seq, role, text AS content FROM conversations
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)""")
def memory_stream(spark, sf):
    """The last three messages per session, kept as stream state."""
    rows = stream.table_stream(spark, sf, "conversations", table(spark, sf, "conversations").schema)
    rows = rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role",
                       F.col("text").alias("content"))
    path = scratch_path(spark, "memory")
    with memory.rocksdb(spark):
        memory.start_memory(rows, path, scratch_path(spark, "checkpoint"), 3).awaitTermination()
    return tables.read_batches(spark, path, "session_id")


def _in_two_runs(spark, rows, by, start):
    """Run a stream over half of the rows, stop it, add the rest, and run it on from its checkpoint."""
    source, checkpoint = scratch_path(spark, "source"), scratch_path(spark, "checkpoint")
    half = F.pmod(F.xxhash64(by), F.lit(2))
    for n in (0, 1):
        rows.where(half == n).write.mode("append").parquet(source)
        start(spark.readStream.schema(rows.schema).parquet(source), checkpoint).awaitTermination()
    return checkpoint


@query(f"""SELECT user_id AS doc_id, {STATUS} AS status FROM events WHERE {STATUS} IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def status_state(spark, sf):
    """Latest upload status out of the stream's state, after two runs of the stream."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.expr(STATUS).alias("status"), "ts",
                                             F.col("event_id").alias("seq")).where("status is not null")
    path = scratch_path(spark, "status")
    return state.status(spark, _in_two_runs(spark, rows, "seq", lambda r, c: stream.start_status(r, path, c)))


@query("""SELECT session_id, seq, role, content, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS INTEGER) AS position
FROM (SELECT conv_id AS session_id, turn AS seq, role, text AS content FROM conversations
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)""")
def memory_state(spark, sf):
    """The last three messages per session out of the stream's state, after two runs of the stream."""
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("seq"), "role", F.col("text").alias("content"))
    path = scratch_path(spark, "memory")
    with memory.rocksdb(spark):
        checkpoint = _in_two_runs(spark, rows, "seq", lambda r, c: memory.start_memory(r, path, c, 3))
    return state.memory(spark, checkpoint)
