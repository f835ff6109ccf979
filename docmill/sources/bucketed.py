"""Chunk and state tables in the catalog, bucketed and sorted by document.

Spark knows how such a table is dealt: a look-up by ids reads their buckets only, and tables
bucketed alike are joined by document without an exchange. All rows of a document are in one
bucket; they come out of one text, so no bucket grows beyond its share by a single key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096


def write_bucketed(rows: DataFrame, name: str, path: str, buckets: int = BUCKETS, owner: str = "doc_id",
                   order: tuple[str, ...] = ("chunk_id",)) -> None:
    """Write table `name` with its files below `path`: one file a bucket, sorted by owner and `order`."""
    (rows.repartition(buckets, owner).write.bucketBy(buckets, owner).sortBy(owner, *order)
     .option("path", path).saveAsTable(name))


def chunks_by_ids(spark: SparkSession, name: str, ids: list, owner: str = "doc_id") -> DataFrame:
    """The rows of a few documents; only the buckets of their ids are read."""
    return spark.table(name).where(F.col(owner).isin(ids))


def per_document(rows: DataFrame, owner: str, columns: list[str], out: str) -> DataFrame:
    """One row a document with its (distinct) rows as an array; the bucketing serves the grouping."""
    return rows.groupBy(owner).agg(F.collect_set(F.struct(*columns)).alias(out))


def missing_rows(chunks: DataFrame, state: DataFrame, columns: tuple[str, ...] = ("chunk_id",),
                 owner: str = "doc_id") -> DataFrame:
    """(owner, *columns) of chunks that the state does not hold; of tables bucketed alike without an exchange.

    The rows of a document are compared as arrays, since a join by owner and chunk would be dealt
    by both.
    """
    now = per_document(chunks, owner, list(columns), "now")
    known = per_document(state, owner, list(columns), "known")
    both = now.join(known, owner, "left")
    left = F.when(F.col("known").isNull(), F.col("now")).otherwise(F.array_except("now", "known"))
    return both.select(owner, F.inline(left))
