"""Batches of questions: vector or keyword search, hybrid retrieval, prompt assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions import prompts, vectors
from docmill.operators import assembly
from docmill.operators.filters import matching_queries
from docmill.operators.keyword_search import bm25_top_k, fused
from docmill.operators.ranking import limited, ordinals
from docmill.operators.vector_search import vector_distances, vector_top_k


def dispatch(chunks: DataFrame, queries: DataFrame, top_k: int | None = 5, top_p: float | None = None) -> DataFrame:
    """Vector search for queries with an embedding, keyword search for the others with a keyword.

    `chunks`: vector_id, doc_id, chunk_id, summary, acl, ts, embedding. A query without either
    has no results. Keyword hits are in (doc_id, chunk_id) order. 0 and None mean no limit: a
    vector search then ranks every vector.
    """
    by_vector = queries.where("embedding is not null")
    by_keyword = queries.where("embedding is null and coalesce(keyword, '') <> ''")
    if top_k:
        near = vector_top_k(chunks, by_vector, top_k, id_col="vector_id", carry=("acl",)).drop("rank")
    else:
        near = vector_distances(chunks, by_vector, id_col="vector_id", carry=("acl",))
    near = near.join(by_vector.select("qid", F.col("acl").alias("_acl")), "qid").where(
        "coalesce(_acl, '') = '' or _acl = acl")
    near = placed(near, ["distance", "vector_id"], top_k, top_p)
    found = matching_queries(chunks, by_keyword, ("doc_id", "chunk_id"), ("vector_id",), top_k or None)
    found = placed(found, ["doc_id", "chunk_id"], top_k, top_p, "matched")
    columns = ["qid", "vector_id", "rank"]
    return (near.select(*columns, F.lit("vector").alias("branch"))
            .unionByName(found.select(*columns, F.lit("keyword").alias("branch"))))


def placed(hits: DataFrame, order: list[str], top_k: int | None, top_p: float | None,
           matched: str | None = None) -> DataFrame:
    """The hits of each query within the limits, with their rank also where there is no limit."""
    if top_k or top_p:
        return limited(hits, order, top_k, top_p, "qid", matched)
    return ordinals(hits, ["qid"], order)


def hybrid(docs: DataFrame, queries: DataFrame, index_path: str, k: int = 5, dim: int = vectors.EMBED_DIM) -> DataFrame:
    """Vector and BM25 hits of text queries, fused by rank. docs: doc_id, text; queries: qid, text.

    `index_path` holds the keyword index of the same documents.
    """
    corpus = docs.select("doc_id", vectors.hashed_embedding(F.col("text"), dim).alias("embedding"))
    asked = queries.select("qid", vectors.hashed_embedding(F.col("text"), dim).alias("embedding"))
    near = vector_top_k(corpus, asked, k, id_col="doc_id")
    return fused(near, bm25_top_k(docs.sparkSession, index_path, queries, k), k)


def prompts_for(queries: DataFrame, hits: DataFrame, texts: DataFrame, id_cols: list[str],
                column: str = "chunk") -> DataFrame:
    """(qid, passages, prompt): every question with the passages of its hits, best first.

    A question without hits has no passages and an empty context.
    """
    found = assembly.context(hits, texts, id_cols, column)
    return queries.join(found, "qid", "left").select(
        "qid", F.coalesce("passages", F.lit(0)).alias("passages"),
        prompts.answer(F.col("text"), F.coalesce("context", F.lit(""))).alias("prompt"))
