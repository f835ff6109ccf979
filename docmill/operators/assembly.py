"""Chunk rows back into documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import BLANK_LINE, join_summaries
from docmill.session import staged


def collected(chunks: DataFrame, *columns: str, id_col: str = "doc_id", order: str = "chunk_id") -> DataFrame:
    """One row per document with each column as an array in chunk order.

    A document's chunks were cut from one text row, so they fit one row again.
    """
    row = F.sort_array(F.collect_list(F.struct(order, *columns))).alias("_rows")
    return chunks.groupBy(id_col).agg(row).select(
        id_col, F.size("_rows").alias("chunks"), *[F.col(f"_rows.{c}").alias(c) for c in columns])


def document_summaries(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Non-empty chunk summaries of a document, joined by a blank line."""
    whole = collected(chunks, "summary", id_col=id_col)
    return whole.select(id_col, "chunks", join_summaries(F.col("summary")).alias("summary"))


def context(hits: DataFrame, texts: DataFrame, id_cols: list[str], column: str = "chunk") -> DataFrame:
    """(qid, context): the texts of the k ranked hits of a query, best first.

    The hits are staged, so Catalyst knows their size and keeps the texts out of a shuffle.
    """
    found = staged(hits.select("qid", "rank", *id_cols), "hits").join(texts.select(*id_cols, column), id_cols)
    rows = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", column))).alias("_rows"))
    return rows.select("qid", F.size("_rows").alias("passages"),
                       F.array_join(F.transform("_rows", lambda r: r[column]), BLANK_LINE).alias("context"))


def zipped(chunks: DataFrame, vectors: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    """Chunks with their vectors by position; a position only one side has is dropped."""
    return chunks.join(vectors, list(keys))
