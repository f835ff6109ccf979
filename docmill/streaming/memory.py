"""Rolling conversation memory: the last n messages of each session, kept as stream state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docmill.sources import tables

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE = "seq long, role string, content string"


class LastMessages(StatefulProcessor):
    """Holds at most n messages per session; each update emits the session's current memory.

    Messages without a number count as the oldest, and are shown behind the others.
    """

    def __init__(self, n: int):
        if n < 1:
            raise ValueError("n must be at least 1")
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getListState("memory", MESSAGE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(m) for m in self.memory.get()] if self.memory.exists() else []
        for batch in rows:  # only n messages stay in memory, however many arrive
            held += [(int(s) if known else None, r, c) for s, r, c, known in
                     batch[["seq", "role", "content", "numbered"]].itertuples(index=False, name=None)]
            held = sorted(held, key=lambda m: (m[0] is not None, m[0] or 0))[-self.n:]
        held.sort(key=lambda m: m[0] is None)
        self.memory.put(held)
        yield pd.DataFrame({"session_id": [key[0]] * len(held), "seq": pd.array([m[0] for m in held], "Int64"),
                            "role": [m[1] for m in held], "content": [m[2] for m in held],
                            "position": range(1, len(held) + 1)})

    def close(self) -> None:
        pass


def newest(messages: DataFrame, n: int) -> DataFrame:
    """Keep the last n messages per session and Arrow batch, before the shuffle: a session that
    holds most of a micro-batch sends n rows per batch to its task. Dropped rows could not
    have been among the last n. `messages` has its sessions, numbers, and whether they are `numbered`."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.sort_values(["numbered", "seq"], kind="stable").groupby("session_id", sort=False, dropna=False).tail(n)

    return messages.mapInPandas(run, messages.schema)


def memory_stream(messages: DataFrame, n: int = 20) -> DataFrame:
    """`messages`: session_id, seq, role, content. Needs the RocksDB state store provider."""
    session = messages.schema["session_id"].dataType.simpleString()
    # pandas would make numbers with nulls among them floats
    rows = messages.select("session_id", F.coalesce("seq", F.lit(0)).alias("seq"), "role", "content",
                           F.col("seq").isNotNull().alias("numbered"))
    return newest(rows, n).groupBy("session_id").transformWithStateInPandas(
        LastMessages(n), f"session_id {session}, seq long, role string, content string, position int",
        "Update", "None")


def start_memory(messages: DataFrame, path: str, checkpoint: str, n: int = 20,
                 trigger: dict | None = None) -> StreamingQuery:
    """Write the memory of every session that changed; `tables.read_batches` gives the newest."""
    return (memory_stream(messages, n).writeStream.outputMode("update")
            .foreachBatch(lambda batch, batch_id: tables.write_batch(batch, path, batch_id))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


@contextmanager
def rocksdb(spark: SparkSession):
    """Start a stateful query with the RocksDB state store, then put the session's setting back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)
