"""Batch inference: user functions over Arrow batches, one call per batch of rows.

A function takes a list of strings and returns one string (or None) per input. A batch with more
than `CALL_BYTES` of texts is sent in several calls. It runs in the tasks, so concurrency is the
number of partitions; pass `partitions` to widen it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions import text as text_fn

BatchFunction = Callable[[list[str]], list]


@dataclass(frozen=True)
class Expression:
    """A summarizer that is a column expression."""

    apply: Callable[[Column], Column]


Summarizer = BatchFunction | Expression
CALL_BYTES = 1 << 20  # texts of one call, which needs several times as much for its copies of them


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = CALL_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose texts in `column` hold about `most` bytes at most, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            held = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, held + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def _attempt(fn: BatchFunction, values: list, tries: int) -> tuple[list, list, list, list]:
    """Answers, errors, tries and calls per value.

    A failing batch is halved until the values that fail stand alone, so one bad value among n
    costs about 2 log n calls. A value alone is tried `tries` times. `calls` counts every call
    that a value was part of; a try is a call that answered it, or failed for it alone.
    """
    n = len(values)
    answers, errors, attempts, calls = [None] * n, [None] * n, [0] * n, [0] * n
    # a stack: functions that call each other would keep the texts of a batch until a collection of garbage
    todo = [(0, n)] if n else []
    while todo:
        low, high = todo.pop()
        for i in range(low, high):
            calls[i] += 1
        failed = []
        try:
            got = list(fn(values[low:high]))
            if len(got) != high - low:
                raise ValueError(f"expected {high - low} answers, got {len(got)}")
        except Exception as e:  # noqa: BLE001  whatever a model raises becomes the row's error
            if high - low > 1:
                middle = (low + high) // 2
                todo += [(middle, high), (low, middle)]
                continue
            got, failed = [], [(low, f"{type(e).__name__}: {e}")]
        for i, answer in enumerate(got, low):
            if answer is None or isinstance(answer, str):
                answers[i], errors[i], attempts[i] = answer, None, attempts[i] + 1
            else:
                failed.append((i, f"TypeError: answer is {type(answer).__name__}, not text"))
        for i, error in failed:
            errors[i], attempts[i] = error, attempts[i] + 1
        todo += [(i, i + 1) for i, _ in reversed(failed) if attempts[i] < tries]
    return answers, errors, attempts, calls


def infer(df: DataFrame, prompt: str, fn: BatchFunction, out: str = "answer", retry: bool = False,
          partitions: int | None = None) -> DataFrame:
    """Add `out`, `{out}_error`, `{out}_attempts`, `{out}_calls` and `{out}_status` ('ok', 'failed', 'skipped').

    Rows never fail the job: an exception, or an answer that is no text, becomes an error text.
    With `retry`, a failed row is tried once more. Rows without a prompt are not sent.
    """
    if partitions:
        df = df.repartition(partitions)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()),
                           T.StructField(f"{out}_error", T.StringType()),
                           T.StructField(f"{out}_attempts", T.IntegerType()),
                           T.StructField(f"{out}_calls", T.IntegerType()),
                           T.StructField(f"{out}_status", T.StringType())])
    tries = 2 if retry else 1

    at, text = df.columns.index(prompt), pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, at):  # columns other than the prompts do not become Python values
            sent = piece.column(at).is_valid().to_pylist()
            results = [iter(x) for x in _attempt(fn, piece.column(at).drop_null().to_pylist(), tries)]
            answers, errors, attempts, calls = (
                [next(x) if s else empty for s in sent] for x, empty in zip(results, (None, None, 0, 0)))
            status = [("ok" if e is None else "failed") if s else "skipped" for s, e in zip(sent, errors)]
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(answers, text), pa.array(errors, text), pa.array(attempts, pa.int32()),
                 pa.array(calls, pa.int32()), pa.array(status, text)], schema.names)

    return df.mapInArrow(run, schema)


# Engines: the built-in ones are column expressions, the named model engines are supplied.
BUILT_IN = {"extractive": Expression(text_fn.extractive_batch), "lead": Expression(text_fn.lead)}
MODEL_ENGINES = ("openai", "langchain", "seq2seq")  # fixed values: accepted model names


def engine(name: str, functions: dict[str, BatchFunction] | None = None) -> Summarizer:
    """The summarizer of that name; a model engine needs its batch function."""
    key = name.lower()
    if key in BUILT_IN:
        return BUILT_IN[key]
    if key in MODEL_ENGINES and functions and key in functions:
        return functions[key]
    raise ValueError(f"Unsupported engine: {name}")


def summarize(chunks: DataFrame, by: str | Summarizer = "extractive",
              functions: dict[str, BatchFunction] | None = None, column: str = "chunk",
              out: str = "summary", partitions: int | None = None) -> DataFrame:
    """A summary per chunk row; a failure gives ''.

    `by` is an engine name, an Expression, or a batch function.
    """
    fn = engine(by, functions) if isinstance(by, str) else by
    if isinstance(fn, Expression):
        return chunks.withColumn(out, F.coalesce(fn.apply(F.col(column)), F.lit("")))
    done = infer(chunks, column, fn, out="_answer", partitions=partitions)
    return done.withColumn(out, F.coalesce("_answer", F.lit(""))).select(*chunks.columns, out)


def evaluated(chunks: DataFrame, fn: BatchFunction) -> DataFrame:
    """Ask a model for a JSON grade of every summary and parse it into `evaluation`.

    Empty summaries have their grade without a call.
    """
    from docmill.functions import prompts, records

    asked = chunks.withColumn("prompt", F.when(F.coalesce("summary", F.lit("")) != "", prompts.evaluate(F.col("summary"))))
    return infer(asked, "prompt", fn).withColumn(
        "evaluation", records.evaluation(F.col("summary"), F.col("answer"))).drop("prompt")


def judged(docs: DataFrame, fns: dict[str, BatchFunction]) -> DataFrame:
    """Model judges: one row per (document, judge); the answer's 'yes' is the vote."""
    from docmill.functions import prompts, records

    asked = docs.select("doc_id", prompts.judge(F.col("text")).alias("prompt"))
    schema = T.StructType([asked.schema["doc_id"], T.StructField("judge", T.StringType()),
                           T.StructField("answer", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 1):  # the texts cross to Python once, for all judges
            prompts_sent = piece.column(1).to_pylist()
            for name, fn in fns.items():
                answers = _attempt(fn, prompts_sent, 1)[0]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([name] * len(answers), pa.string()),
                                                  pa.array(answers, pa.string())], schema.names)

    answered = asked.mapInArrow(run, schema)
    return answered.select("doc_id", "judge", records.is_yes(F.col("answer")).alias("vote"))
