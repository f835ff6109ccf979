"""Phrase and proximity search over positional postings; no text is read.

The index holds a row (term, id, positions) for every document and distinct term, partitioned by a
hash of the term; frequent terms are split over files. Phrases come as a table. A search reads the
partitions of the asked terms, keeps documents that hold all words of a phrase, and only then
compares positions, document by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.text import tokens
from docmill.operators.keyword_search import PARTITIONS, bounded, part_of, properties
from docmill.session import small_batches, staged


def positions_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, id, positions): one row per document and distinct term, made in the task that scans the text."""
    rows = docs.select(id_col, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("tokens"))
    schema = T.StructType([T.StructField("term", T.StringType()), rows.schema[id_col],
                           T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            lists = batch.column(1)
            length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().dictionary_encode()
            owner = np.repeat(np.arange(len(length)), length)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
            number = words.indices.to_numpy()
            order = np.lexsort((at, number, owner))
            owner, number, at = owner[order], number[order], at[order]
            new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])][:len(owner)])
            yield pa.RecordBatch.from_arrays(
                [words.dictionary.take(pa.array(number[new])), batch.column(0).take(pa.array(owner[new])),
                 pa.ListArray.from_arrays(pa.array(np.r_[new, len(owner)], pa.int32()), pa.array(at, pa.int32()))], schema.names)

    return rows.mapInArrow(place, schema)


def write_positions(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text",
                    partitions: int = PARTITIONS) -> None:
    """Write the positional index of `docs` below `path`."""
    rows = positions_of(docs, id_col, text)
    docs.sparkSession.createDataFrame([(partitions, rows.schema.json())], "partitions int, columns string").coalesce(
        1).write.json(f"{path}/properties")
    with small_batches(docs.sparkSession):
        (rows.withColumn("part", part_of(F.col("term"), partitions)).hint("rebalance", "part")
         .sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{path}/positions"))


def holding_all(spark: SparkSession, path: str, asked: DataFrame, id_col: str) -> DataFrame:
    """(qid, id, n, terms): for documents with all words that a query asks for (qid, term, places), their positions.

    `terms` is an array of (places in the query, positions in the document), one entry a distinct word.
    """
    partitions, columns = properties(spark, path)
    asked = staged(asked.withColumn("part", part_of(F.col("term"), partitions)).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("qid"))), "asked")
    wanted = [r[0] for r in asked.select("part").distinct().collect()]  # at most `partitions` numbers
    rows = spark.read.schema(columns.add("part", T.IntegerType())).parquet(f"{path}/positions").where(
        F.col("part").isin(wanted))
    found = rows.drop("part").join(asked.drop("part"), "term")
    return found.groupBy("qid", id_col, "n").agg(
        F.collect_list(F.struct("places", "positions")).alias("terms")).where(F.size("terms") == F.col("n"))


def words_asked(queries: DataFrame) -> DataFrame:
    """(qid, term, places): the distinct words of each query text and where they stand in it."""
    words = queries.select("qid", F.posexplode(tokens(F.col("text"))).alias("at", "term"))
    return words.groupBy("qid", "term").agg(F.sort_array(F.collect_list("at")).alias("places"))


def phrase_hits(spark: SparkSession, path: str, queries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(qid, id, n_places, first): where the words of a query (qid, text) stand next to each other, in order.

    A query without a word has no hits. `first` is the number of the first place's first word.
    """
    held = holding_all(spark, path, words_asked(queries), id_col)
    begins = F.flatten(F.transform("terms", lambda t: F.flatten(F.transform(
        t["places"], lambda p: F.transform(t["positions"], lambda x: x - p)))))
    words = F.aggregate("terms", F.lit(0), lambda n, t: n + F.size(t["places"]))
    starts = held.select("qid", id_col, words.alias("words"), F.explode(begins).alias("start"))
    # a phrase begins where each of its words says so
    whole = starts.groupBy("qid", id_col, "words", "start").agg(F.count(F.lit(1)).alias("n")).where("n = words")
    return whole.groupBy("qid", id_col).agg(F.count(F.lit(1)).alias("n_places"), F.min("start").alias("first"))


def proximity_hits(spark: SparkSession, path: str, queries: DataFrame, within: int, id_col: str = "doc_id") -> DataFrame:
    """(qid, id, span, first): documents in which all distinct words of a query stand within `within` words, in any order.

    `span` is the smallest number of words that holds them all, `first` where the first such stretch begins.
    """
    if within < 1:
        raise ValueError("a stretch has at least one word")
    held = holding_all(spark, path, words_asked(queries), id_col)
    each = held.select("qid", id_col, "n", F.posexplode("terms").alias("word", "t")).select(
        "qid", id_col, "n", "word", F.explode("t.positions").alias("at"))
    # every stretch is taken from its first word on; its end is the last of the words' first places in it
    ahead = Window.partitionBy("qid", id_col).orderBy("at").rangeBetween(0, within - 1)
    seen = each.withColumn("seen", F.collect_list(F.struct("word", "at")).over(ahead))
    lasts = F.transform(F.array_distinct("seen.word"), lambda w: F.array_min(
        F.transform(F.filter("seen", lambda s: s["word"] == w), lambda s: s["at"])))
    stretches = seen.select("qid", id_col, "n", "at", lasts.alias("lasts")).where(F.size("lasts") == F.col("n"))
    best = F.min(F.struct((F.array_max("lasts") - F.col("at") + 1).alias("span"), F.col("at").alias("first")))
    return stretches.groupBy("qid", id_col).agg(best.alias("best")).select("qid", id_col, "best.*")
