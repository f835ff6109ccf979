"""BM25 keyword retrieval over a stored index, and rank fusion.

The index is two tables, written once: `postings` (term, id, tf, length), partitioned by a hash
of the term, and `terms` (term, df, length). A search reads only the partitions of the asked
terms and never a text. The rows of frequent terms are split over files, so no term is one
task's work. The empty term, which no token is, stands for the document itself: its row in
`terms` holds the number of documents and their total length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.text import tokens
from docmill.operators.topk import MATRIX_CELLS, Kernel, ranked, top_k
from docmill.session import small_batches, staged

# Published defaults (Robertson & Zaragoza 2009; Cormack et al. 2009).
K1 = 1.2
B = 0.75
RRF_OFFSET = 60
EVERY = ""
PARTITIONS = 256
KERNEL_TOKENS = 1 << 18  # tokens of one kernel call, which needs some 100 bytes for each


def bounded(batches: Iterator[pa.RecordBatch], column: int, most: int = KERNEL_TOKENS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose lists in `column` hold about `most` items at most, or one row: what a kernel needs beside them."""
    for batch in batches:
        ends = np.cumsum(batch.column(column).value_lengths().to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            held = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, held + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def postings_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, id, tf, length): one row per document and distinct term, and one for the document.

    The tokens of a batch are counted together in one kernel, in the task that scans them.
    """
    rows = docs.select(id_col, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("tokens"))
    schema = T.StructType([T.StructField("term", T.StringType()), rows.schema[id_col],
                           T.StructField("tf", T.LongType()), T.StructField("length", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            lists = batch.column(1)
            length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().dictionary_encode()
            vocabulary = words.dictionary
            owner = np.repeat(np.arange(len(length)), length)
            key, tf = np.unique(owner * max(1, len(vocabulary)) + words.indices.to_numpy(), return_counts=True)
            doc, term = np.divmod(key, max(1, len(vocabulary)))
            term = pa.concat_arrays([vocabulary.take(pa.array(term)), pa.array([EVERY] * len(length), vocabulary.type)])
            doc = np.r_[doc, np.arange(len(length))]
            yield pa.RecordBatch.from_arrays(
                [term, batch.column(0).take(pa.array(doc)), pa.array(np.r_[tf, np.ones(len(length), np.int64)]),
                 pa.array(length[doc])], schema.names)

    return rows.mapInArrow(count, schema)


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text",
                partitions: int = PARTITIONS) -> None:
    """Write the index of `docs` below `path`."""
    write_postings(postings_of(docs, id_col, text), path, partitions)


def write_postings(rows: DataFrame, path: str, partitions: int = PARTITIONS, order: tuple[str, ...] = ("term",)) -> None:
    """Write an index below `path` from the rows of `postings_of`, which may have more columns."""
    spark = rows.sparkSession
    spark.createDataFrame([(partitions, rows.schema.json())], "partitions int, columns string").coalesce(1).write.json(
        f"{path}/properties")
    # rebalance splits a partition that holds a frequent term over several tasks and files
    with small_batches(spark):
        (rows.withColumn("part", part_of(F.col("term"), partitions)).hint("rebalance", "part")
         .sortWithinPartitions("part", *order).write.partitionBy("part").parquet(f"{path}/postings"))
    stored_postings(spark, path).groupBy("part", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("length").alias("length")).write.partitionBy("part").parquet(f"{path}/terms")


def part_of(term: Column, partitions: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(partitions)).cast("int")


def properties(spark: SparkSession, path: str) -> tuple[int, T.StructType]:
    row = spark.read.json(f"{path}/properties").first()
    return row["partitions"], T.StructType.fromJson(json.loads(row["columns"]))


def stored_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(properties(spark, path)[1].add("part", T.IntegerType())).parquet(f"{path}/postings")


def stored_terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, df long, length long, part int").parquet(f"{path}/terms")


def terms_of(spark: SparkSession, path: str) -> DataFrame:
    """(term, df): the vocabulary with document frequencies."""
    return stored_terms(spark, path).where(F.col("term") != EVERY).select("term", "df")


def asked_index(spark: SparkSession, path: str, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the index that the queries need: per document its asked terms, per query its terms' idf."""
    partitions, _ = properties(spark, path)
    terms = stored_terms(spark, path)
    asked = staged(queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).withColumn(
        "part", part_of(F.col("term"), partitions)), "asked")
    wanted = [r[0] for r in asked.select("part").distinct().collect()]  # at most `partitions` numbers
    corpus = terms.where(F.col("term") == EVERY).select("df", "length").first()
    n, mean = (corpus["df"], corpus["length"] / corpus["df"]) if corpus else (0, 0.0)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # the asked terms with their frequencies: staged, so Catalyst knows their size in both joins
    known = staged(terms.where(F.col("part").isin(wanted)).join(asked.select("term").distinct(), "term", "left_semi")
                   .select("term", idf.alias("idf")), "known")
    weighted = asked.join(known, "term").groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("terms")).withColumn("mean_length", F.lit(float(mean)))
    rows = stored_postings(spark, path).where(F.col("part").isin(wanted))
    return rows.join(known.select("term"), "term", "left_semi"), weighted


def bm25_kernel(k1: float = K1, b: float = B) -> Kernel:
    """BM25 of documents (terms, tfs, length) for a block of queries (terms with idf, mean_length).

    Only (document, term, query) triples that exist are added up, in the order of the terms, so
    equal documents have equal scores wherever they stand.
    """
    def prepare(block: pa.Table):
        flat = block["terms"].combine_chunks()
        terms, idf = flat.flatten().field("term"), flat.flatten().field("idf").to_numpy()
        vocabulary = pc.unique(terms).sort()
        number, owner = pc.index_in(terms, vocabulary).to_numpy(), pc.list_parent_indices(flat).to_numpy()
        order = np.argsort(number, kind="stable")
        starts = np.searchsorted(number[order], np.arange(len(vocabulary) + 1))
        mean = block["mean_length"][0].as_py() if block.num_rows else 0.0
        return vocabulary, starts, owner[order], idf[order], mean, block.num_rows

    def cost(state, rows: pa.Table) -> np.ndarray:
        vocabulary, starts, askers, idf, mean, nq = state
        lists = rows["postings"].combine_chunks()
        flat = lists.flatten()
        length = rows["length"].to_numpy().astype(np.float64)
        doc = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        term = pc.fill_null(pc.index_in(flat.field("term"), vocabulary), -1).to_numpy()
        tf = flat.field("tf").to_numpy().astype(np.float64)
        doc, term, tf = doc[term >= 0], term[term >= 0], tf[term >= 0]
        order = np.lexsort((term, doc))
        doc, term, tf = doc[order], term[order], tf[order]
        weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / (mean or 1.0)))
        score = np.zeros(rows.num_rows * nq)
        sizes = starts[term + 1] - starts[term]
        bounds = np.r_[0, np.cumsum(sizes)]
        at = 0
        while at < len(term):  # a bounded number of triples at a time
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + MATRIX_CELLS, "right")) - 1)
            n = sizes[at:end]
            which = np.repeat(starts[term[at:end]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            np.add.at(score, np.repeat(doc[at:end], n) * nq + askers[which], np.repeat(weight[at:end], n) * idf[which])
            at = end
        score = score.reshape(rows.num_rows, nq).T
        return np.where(score > 0, -score, np.nan)

    return Kernel(prepare, cost)


def bm25_top_k(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, *, id_col: str = "doc_id",
               k1: float = K1, b: float = B, **options) -> DataFrame:
    """Best documents by BM25 from the index at `path`: (qid, id, score, rank). `queries` has (qid, text).

    Only postings of asked terms move, once, whatever the number of queries.
    """
    postings, weighted = asked_index(spark, path, queries)
    return best_of(postings, weighted, k, id_col=id_col, k1=k1, b=b, **options)


def best_of(postings: DataFrame, weighted: DataFrame, k: int, *, id_col: str = "doc_id", k1: float = K1, b: float = B,
            **options) -> DataFrame:
    """(qid, id, score, rank) of the documents to which the postings belong."""
    docs = postings.groupBy(id_col).agg(F.collect_list(F.struct("term", "tf")).alias("postings"),
                                        F.max("length").alias("length"))
    hits = top_k(docs, weighted, bm25_kernel(k1, b), k, id_col=id_col, **options)
    return hits.select("qid", id_col, (-F.col("cost")).alias("score"), "rank")


def fused(vector_hits: DataFrame, keyword_hits: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of two hit lists: each adds 1 / (60 + rank) where it has the document."""
    v = vector_hits.select("qid", id_col, F.col("rank").alias("vector_rank"))
    w = keyword_hits.select("qid", id_col, F.col("rank").alias("keyword_rank"))
    part = lambda c: F.coalesce(1.0 / (F.lit(RRF_OFFSET) + F.col(c)), F.lit(0.0))
    both = v.join(w, ["qid", id_col], "full_outer").withColumn("score", part("vector_rank") + part("keyword_rank"))
    return ranked(both, "qid", [F.col("score").desc(), F.col(id_col)], k)
