"""The current rows of a running stream, read out of its state instead of the batches that it has written.

Spark's state data source reads the state store of a checkpoint as of its last committed batch, also while the stream
runs. The cost grows with the number of keys, not with the number of batches, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def status(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(doc_id, status) of the stream that `ingest.start_status` has started with this checkpoint."""
    rows = spark.read.format("statestore").load(checkpoint)
    held = rows.schema["value"].dataType.fieldNames()[0]  # the aggregate's value; what orders it comes behind
    return rows.select(F.col("key.doc_id"), F.col("value").getField(held).alias("status"))


def memory(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session_id, seq, role, content, position) of the stream that `memory.start_memory` has started with this checkpoint."""
    rows = (spark.read.format("statestore").option("stateVarName", "memory").option("flattenCollectionTypes", "false")
            .load(checkpoint))
    return rows.select(F.col("key.session_id"), F.posexplode("list_value").alias("at", "m")).select(
        "session_id", "m.seq", "m.role", "m.content", (F.col("at") + 1).alias("position"))
