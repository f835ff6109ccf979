"""Summaries with a second attempt: summarize, score, summarize weak documents again, index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.records import summary_score
from docmill.functions.text import extractive, lead
from docmill.operators import inference, quality
from docmill.operators.chunking import chunks_of
from docmill.session import staged


def refined(docs: DataFrame, first: Callable[[Column], Column] = lead,
            second: Callable[[Column], Column] = extractive, threshold: float = quality.THRESHOLD,
            strategy: str = "paragraph_raw", **options) -> DataFrame:
    """(doc_id, chunk_id, chunk, summary, score, decision), with column-expression summarizers.

    All chunks of a document are in its row, so the decision over their scores needs no
    shuffle; the second summary is evaluated only where the first was rejected.
    """
    row = docs.select("doc_id", chunks_of(F.col("text"), strategy, **options).alias("_chunks"))
    row = row.withColumn("_first", F.transform("_chunks", first))
    row = row.withColumn("decision", quality.decision_of(F.transform("_first", summary_score), threshold))
    final = F.when(F.col("decision") == "resummarize", F.transform("_chunks", second)).otherwise(F.col("_first"))
    rows = row.select("doc_id", "decision", F.posexplode(F.arrays_zip(
        F.col("_chunks").alias("chunk"), final.alias("summary"))).alias("chunk_id", "_r"))
    return (rows.select("doc_id", "chunk_id", "_r.chunk", "_r.summary", "decision")
            .withColumn("score", summary_score(F.col("summary"))))


def refined_by_models(chunks: DataFrame, first, second, threshold: float = quality.THRESHOLD) -> DataFrame:
    """The same for batch functions over chunk rows.

    The first summaries are staged, so the first model sees every chunk once and both branches
    go by the same answers. The flags are combined map-side (one row per document and task)
    and joined back; a document with very many chunks is split by the adaptive skew join.
    """
    once = staged(quality.scored(inference.summarize(chunks, first)), "first")
    flags = staged(once.groupBy("doc_id").agg(F.bool_or(F.col("score") < threshold).alias("_low")).where("_low"), "weak")
    weak = once.join(flags.select("doc_id"), "doc_id", "left_semi").drop("summary", "score")
    kept = once.join(flags.select("doc_id"), "doc_id", "left_anti")
    return kept.withColumn("decision", F.lit("index")).unionByName(
        quality.scored(inference.summarize(weak, second)).withColumn("decision", F.lit("resummarize")))
