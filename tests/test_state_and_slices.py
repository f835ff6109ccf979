"""Rows out of a stream's state, and token windows as slices of the text."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docmill.operators import token_slices as TS
from docmill.session import scratch_path
from docmill.streaming import ingest as stream, memory, state


def test_status_state_after_each_run(spark, tmp_path):
    schema, checkpoint, path = "doc_id string, status string, ts long, seq long", scratch_path(spark, "c"), scratch_path(spark, "s")

    def feed(name, rows):
        pd.DataFrame(rows, columns=["doc_id", "status", "ts", "seq"]).to_parquet(tmp_path / f"{name}.parquet")
        source = spark.readStream.schema(schema).parquet(str(tmp_path))
        stream.start_status(source, path, checkpoint).awaitTermination()
        return {r.doc_id: r.status for r in state.status(spark, checkpoint).collect()}

    assert feed("a", [("x", "old", 1, 1), ("x", "new", 2, 1), ("y", "one", 1, 1)]) == {"x": "new", "y": "one"}
    assert feed("b", [("x", "late", 1, 9), ("y", "tie", 1, 2), ("z", "first", 0, 0)]) == {"x": "new", "y": "tie", "z": "first"}


def test_memory_state_after_each_run(spark, tmp_path):
    schema, checkpoint, path = "session_id string, seq long, role string, content string", scratch_path(spark, "c"), scratch_path(spark, "m")

    def feed(name, rows):
        pd.DataFrame(rows, columns=["session_id", "seq", "role", "content"]).to_parquet(tmp_path / f"{name}.parquet")
        source = spark.readStream.schema(schema).parquet(str(tmp_path))
        with memory.rocksdb(spark):
            memory.start_memory(source, path, checkpoint, 2).awaitTermination()
        return sorted(tuple(r) for r in state.memory(spark, checkpoint).collect())

    assert feed("a", [("s", i, "user", f"m{i}") for i in range(4)] + [("t", 0, "user", "x")]) == [
        ("s", 2, "user", "m2", 1), ("s", 3, "user", "m3", 2), ("t", 0, "user", "x", 1)]
    assert feed("b", [("s", 4, "user", "m4"), ("u", 7, "bot", None)]) == [
        ("s", 3, "user", "m3", 1), ("s", 4, "user", "m4", 2), ("t", 0, "user", "x", 1), ("u", 7, "bot", None, 1)]


# ---- slices -----------------------------------------------------------------------------

TEXTS = ["plain words of a text", "", None, " " * 3000, "\n\n\t  x", "👩‍👩‍👧‍👦 family 😀😀😀 é é    end ", "日本語のテキスト" * 50,
         "word " * 2000, "a", "tabs\t\t\tand\r\nlines\n", "퟿ \x00 \x1f", "1234567890" * 30]


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return Path(public.path("byte_bpe_50k.json")).read_text(encoding="utf-8")


@pytest.mark.parametrize("size", [1, 2, 7, 512])
def test_windows_put_together_are_the_text(spark, vocabulary, size):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id int, text string, chunk string")
    got = TS.chunk(docs, TS.library_starts(vocabulary), size).orderBy("doc_id", "chunk_id").collect()
    encode = TS.library_starts(vocabulary)()
    for i, t in enumerate(TEXTS):
        own = [r.chunk for r in got if r.doc_id == i]
        assert "".join(own) == (t or "") and all(own)
        assert [r.chunk_id for r in got if r.doc_id == i] == list(range(len(own)))
        if t:
            n = len(encode(t))
            assert len(own) <= -(-n // size)
            if t.isascii():  # one token never begins within a character: windows hold `size` tokens each
                starts = encode(t)
                at = np.cumsum([0, *map(len, own)])
                counts = np.histogram(starts, at)[0] if len(own) > 1 else [n]
                assert all(c <= size for c in counts) and sum(counts) == n


def test_other_tokenizers_may_leave_out_text(spark):
    """Text between tokens, before the first and after the last stays in the windows."""
    import re

    def load():
        return lambda t: np.array([m.start() for m in re.finditer(r"\w+", t)], np.int64)
    docs = spark.createDataFrame([(1, "  one, two;  three.  four "), (2, " ... "), (3, "")], "doc_id int, text string")
    got = {r.doc_id: r.w for r in docs.select("doc_id", TS.token_slices(F.col("text"), load, 2).alias("w")).collect()}
    assert got == {1: ["  one, two;  ", "three.  four "], 2: [" ... "], 3: []}
    assert TS.chunk(docs.limit(0), load, 2).collect() == []
    with pytest.raises(ValueError):
        TS.token_slices(F.col("text"), load, 0)
