"""BM25 over blocks of postings: a search moves only postings of blocks that can hold a hit.

Documents of about the same length form blocks of some 64. For every term and block that holds it the
index keeps the largest frequency and the smallest length there, which bound the term's weight in
the block. A search adds up the bounds of a query's terms per block, scores the most promising
blocks, and so knows a score that the last hit must reach. Only blocks whose bound reaches that
score are scored then; the result is that of `keyword_search.bm25_top_k`, ties included.

The bounds are one narrow row per query and block that holds one of its terms, a small part of the
postings for a frequent term. Rare terms have as many blocks as postings, and queries of many
frequent terms have bounds that prune little: there the plain search is as good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.keyword_search import (
    B, EVERY, K1, PARTITIONS, asked_index, best_of, part_of, postings_of, properties, stored_postings, write_postings)
from docmill.operators.topk import ranked
from docmill.session import small_batches, staged

BLOCK_DOCS = 64
#: Lengths that differ by less than this factor may share a block.
LENGTH_STEP = 1.1
#: Sums of the same weights in another order differ by less than this share.
ROUNDING = 1e-9


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", partitions: int = PARTITIONS,
                block_docs: int = BLOCK_DOCS) -> None:
    """Write postings, terms and the bounds of all blocks below `path`."""
    spark = docs.sparkSession
    step = F.floor(F.log(F.greatest(F.col("length"), F.lit(1))) / F.log(F.lit(LENGTH_STEP))).alias("step")
    with small_batches(spark):
        rows = staged(postings_of(docs, id_col, text).select("*", step), "postings")
    # one row per step of lengths: a few hundred, whatever the number of documents
    steps = rows.where(F.col("term") == EVERY).groupBy("step").agg(
        F.ceil(F.count(F.lit(1)) / block_docs).alias("blocks"))
    block = F.col("step") * F.lit(1 << 40) + F.pmod(F.xxhash64(F.col(id_col)), F.col("blocks"))
    rows = rows.join(F.broadcast(steps), "step").withColumn("block", block).drop("step", "blocks")
    write_postings(rows, path, partitions, ("term", "block"))
    (stored_postings(spark, path).where(F.col("term") != EVERY).groupBy("part", "term", "block")
     .agg(F.max("tf").alias("tf"), F.min("length").alias("length"))
     .write.partitionBy("part").parquet(f"{path}/blocks"))


def weight(mean: Column, k1: float, b: float) -> Column:
    """The weight of `tf` occurrences in a text of `length`: it grows with `tf` and shrinks with `length`."""
    tf = F.col("tf")
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / mean))


def bounds(spark: SparkSession, path: str, asked: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, block, bound): what a document of the block can score at most. `asked` has (qid, term, idf, mean_length)."""
    partitions, _ = properties(spark, path)
    wanted = [r[0] for r in asked.select(part_of(F.col("term"), partitions)).distinct().collect()]  # at most `partitions`
    blocks = spark.read.schema("term string, block long, tf long, length long, part int").parquet(f"{path}/blocks")
    return (blocks.where(F.col("part").isin(wanted)).join(asked, "term")
            .groupBy("qid", "block").agg(F.sum(F.col("idf") * weight(F.col("mean_length"), k1, b)).alias("bound")))


def pruned(spark: SparkSession, path: str, queries: DataFrame, k: int, *, id_col: str = "doc_id", k1: float = K1,
           b: float = B, **options) -> tuple[DataFrame, DataFrame]:
    """The postings that can matter to the k best documents of the queries, and the queries' weighted terms.

    Where two queries ask for different terms of a block, one of them may see a document with some of its terms only.
    Its sum is then below the true score, which is below what the query's last hit must reach.
    """
    postings, weighted = asked_index(spark, path, queries)
    weighted = staged(weighted, "weighted")
    asked = weighted.select("qid", "mean_length", F.explode("terms").alias("t")).select("qid", "mean_length", "t.*")
    bound = staged(bounds(spark, path, asked, k1, b), "bounds")

    def of(kept: DataFrame) -> DataFrame:
        pairs = kept.join(asked, "qid").select("term", "block").distinct()
        return postings.join(pairs, ["term", "block"], "left_semi")

    # every block holds a document that scores, so k blocks give k scores if there are as many
    first = of(ranked(bound, "qid", [F.col("bound").desc(), F.col("block")], k).select("qid", "block"))
    least = best_of(first, weighted, k, id_col=id_col, k1=k1, b=b, **options).where(F.col("rank") == k)
    reached = bound.join(least.select("qid", "score"), "qid", "left").where(
        F.col("score").isNull() | (F.col("bound") >= F.col("score") * (1 - ROUNDING)))
    return of(reached.select("qid", "block")), weighted


def bm25_top_k(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, *, id_col: str = "doc_id",
               k1: float = K1, b: float = B, **options) -> DataFrame:
    """Best documents by BM25 from the index at `path`: (qid, id, score, rank). `queries` has (qid, text)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    postings, weighted = pruned(spark, path, queries, k, id_col=id_col, k1=k1, b=b, **options)
    return best_of(postings, weighted, k, id_col=id_col, k1=k1, b=b, **options)
