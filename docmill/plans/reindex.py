"""Reindex one or many documents in one job: full or incremental."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import vectors
from docmill.operators import index, inference
from docmill.operators.chunking import chunk
from docmill.plans.ingest import chunk_rows, described, embedded, finished
from docmill.session import short_shuffles, staged, workspace
from docmill.sources import documents, tables

#: Bytes of text that a round of `reindex` takes, and the most rounds of a run, since each reads the documents again.
ROUND_BYTES, ROUNDS = 64 << 20, 16


def to_index(docs: DataFrame, state: DataFrame, mode: str = "hash", full: bool = False,
             strategy: str = "paragraph", **options) -> DataFrame:
    """Chunk rows that have to be (re)indexed.

    'code' skips a document whose stored version is current and otherwise takes the missing
    chunk numbers, even after an interrupted run. 'hash' compares every chunk's number and
    text. `full` takes everything. Keywords are extracted only for documents that have a chunk
    to index.
    """
    if mode not in ("code", "hash"):
        raise ValueError(f"Unsupported reindex mode: {mode}")
    if full:
        return chunk_rows(described(docs), strategy, **options)
    if mode == "code":  # versions are compared before any text is chunked
        todo = index.changed_documents(docs, state)
        return index.missing_by_id(chunk_rows(described(todo), strategy, **options), state)
    missing = staged(index.missing_keys(hashed_chunks(docs, strategy, **options), state), "missing")
    return chunks_with(docs, missing, strategy, **options)


def hashed_chunks(docs: DataFrame, strategy: str = "paragraph", **options) -> DataFrame:
    """(doc_id, chunk_id, chunk_hash) of all chunks, without the metadata that a chunk row carries."""
    return chunk(docs, strategy, **options).select("doc_id", "chunk_id", index.chunk_hash(F.col("chunk")).alias("chunk_hash"))


def chunks_with(docs: DataFrame, keys: DataFrame, strategy: str = "paragraph", **options) -> DataFrame:
    """The chunk rows with the given (doc_id, chunk_id); other documents are not chunked."""
    some = docs.join(keys.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = chunk_rows(described(some), strategy, **options)
    return rows.join(keys.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_semi").withColumn(
        "chunk_hash", index.chunk_hash(F.col("chunk")))


def reindex(spark: SparkSession, docs: DataFrame, index_path: str, state_path: str, now: int, *,
            mode: str = "hash", full: bool = False, ids: DataFrame | None = None,
            summarizer="lead", functions: dict | None = None, embed=vectors.hashed_embedding,
            strategy: str = "paragraph", buckets: int = tables.BUCKETS, **options) -> DataFrame:
    """Bring index and state up to date; returns the progress of the documents.

    Of both tables only the partitions of the given documents are read, and only those of changed
    documents are written. Running it again, also after a failure between the two writes, indexes what is
    still missing and nothing else. Many documents are taken in rounds, each those of some partitions: what a
    round stages and shuffles is dropped at its end, so the disk holds the tables and that of one round. Every round
    reads the documents again. A run that fails leaves the rounds before it done.
    """
    if mode not in ("code", "hash"):
        raise ValueError(f"Unsupported reindex mode: {mode}")
    if ids is not None:
        docs = documents.listed(docs, ids)
    if "version" not in docs.columns:
        docs = docs.withColumn("version", F.lit(index.UNKNOWN_VERSION))
    sized = staged(docs.select("doc_id", F.coalesce("version", F.lit(index.UNKNOWN_VERSION)).alias("version"),
                               F.octet_length("text").alias("size")), "versions")
    versions = sized.drop("size")
    rounds = min(ROUNDS, buckets, 1 + (sized.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0) // ROUND_BYTES)

    rows_table = tables.Keyed(spark, index_path, ("vector_id",), buckets=buckets)
    state_table = tables.Keyed(spark, state_path, buckets=buckets)

    for n in range(rounds):
        mine = tables.bucket_of("doc_id", buckets) % rounds == n if rounds > 1 else F.lit(True)
        with workspace(spark), short_shuffles(spark):
            _reindex_round(docs.where(mine), versions.where(mine), rows_table, state_table, now, mode, full, summarizer,
                           functions, embed, strategy, options)
    return index.progress(state_table.read(versions), versions)


def _reindex_round(docs: DataFrame, versions: DataFrame, rows_table: tables.Keyed, state_table: tables.Keyed, now: int, mode: str,
                   full: bool, summarizer, functions: dict | None, embed, strategy: str, options: dict) -> None:
    def finish(todo: DataFrame) -> DataFrame:
        return staged(finished(embedded(inference.summarize(todo, summarizer, functions), embed), now), "reindex")

    if full:
        rows = finish(to_index(docs, None, full=True, strategy=strategy, **options))
        rows_table.replace(rows, versions, written=True)
        state_table.replace(index.state_rows(rows), versions)
        return
    nothing = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, version string, chunk_id int, chunk_hash string"
    state = state_table.read(versions) if state_table.exists() else docs.sparkSession.createDataFrame([], nothing)
    gone = None
    if mode == "hash":  # the texts are chunked once to compare, and again only where a chunk is missing
        current = staged(hashed_chunks(docs, strategy, **options), "current")
        rows = finish(chunks_with(docs, staged(index.missing_keys(current, state), "missing"), strategy, **options))
        if rows_table.exists():
            written = rows_table.read(versions).select("doc_id", "chunk_id", "vector_id")
            gone = staged(written.join(current.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti"), "stale")
    else:
        rows = finish(to_index(docs, state, mode, False, strategy, **options))
    rows_table.upsert(rows, gone=gone, written=True)
    touched = rows.select("doc_id").unionByName(index.changed_documents(versions, state).select("doc_id"))
    if gone is not None:
        touched = touched.unionByName(gone.select("doc_id"))
    # The state follows the index table, so it never claims a chunk that was not written.
    touched = staged(versions.join(touched.distinct(), "doc_id", "left_semi"), "touched")
    there = rows_table.read(touched).select("doc_id", "chunk_id", "chunk_hash").join(touched, "doc_id")
    state_table.replace(index.state_rows(there), touched)


def dry_run(docs: DataFrame, state: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Version and indexed chunks per document; writes nothing."""
    return index.dry_run(documents.listed(docs, ids) if ids is not None else docs, state)
