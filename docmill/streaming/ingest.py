"""Continuous ingest: new documents are indexed batch by batch, exactly once in effect."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docmill.operators import index
from docmill.plans.ingest import ingest
from docmill.session import staged
from docmill.sources import tables
from docmill.sources.documents import file_id, file_text


def text_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream of whole text files: (doc_id, text, last_modified)."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.text(path, wholetext=True)
    return files.select(file_id().alias("doc_id"), file_text().alias("text"),
                        F.col("_metadata.file_modification_time").alias("last_modified"))


def table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A stream over the parquet files of a table: files of its name, or folders of such a name with any files in them."""
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}*.parquet")


AVAILABLE_NOW = {"availableNow": True}


def start(docs: DataFrame, index_path: str, state_path: str, audit_path: str, checkpoint: str, now: int | None = None,
          trigger: dict | None = None, **settings) -> StreamingQuery:
    """Index every new document, record the state and an audit event per document.

    A batch only adds its own folder to each table, so the cost of a batch does not grow with
    the index, and a batch that runs twice leaves the same tables. `tables.read_batches` gives
    the current rows; a document that arrives again replaces its older rows there, also when it
    has none any more. Rows get the time of their batch, or `now`. `trigger` holds the options
    of Spark's trigger, such as processingTime; without it the stream ends with what is there.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = staged(batch, "arrived")
        owners = batch.select("doc_id").distinct()
        at = int(time.time()) if now is None else now
        rows = staged(ingest(batch, at, **settings), "batch")
        tables.write_batch(rows, index_path, batch_id, owners)
        tables.write_batch(index.state_rows(rows), state_path, batch_id, owners)
        events = rows.select(F.lit("indexed").alias("event"), F.col("doc_id").cast("string").alias("doc_id"))
        tables.write_batch(events.distinct(), audit_path, batch_id)

    return (docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or AVAILABLE_NOW)).start())


def start_status(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write every change of a document's latest status; events: doc_id, status, ts, seq."""
    return (index.latest_status(events).writeStream.outputMode("update")
            .foreachBatch(lambda batch, batch_id: tables.write_batch(batch, path, batch_id))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or AVAILABLE_NOW)).start())
