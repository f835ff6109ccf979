"""Tag search by bitmaps: one bitmap per tag and range of ids, no text read.

The index holds a row (tag, bucket, bits) for every tag and every range of 32,768 ids in which a
document has the tag, partitioned by a hash of the tag. The empty tag, which no document has,
stands for all documents. A tag that every document has is as many rows as there are ranges, so
it is no single task's work. A search reads the partitions of the asked tags and combines bitmaps
range by range. Ids are whole numbers; bitmaps pay where these are dense, as after numbering.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.keyword_search import part_of

EVERY = ""
PARTITIONS = 256
RANGE = 1 << 15
INDEX = "tag string, bucket long, bits binary, part int"


def write_tag_index(tagged: DataFrame, path: str, column: str = "keywords", partitions: int = PARTITIONS) -> None:
    """Index rows (doc_id, tags); null and empty tags count for nothing, rows without an id are left out."""
    tags = F.filter(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda t: t != EVERY)
    rows = tagged.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.concat(F.array(F.lit(EVERY)), F.array_distinct(tags))).alias("tag"))
    bitmaps = rows.groupBy("tag", F.bitmap_bucket_number("doc_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("bits"))
    (bitmaps.withColumn("part", part_of(F.col("tag"), partitions)).hint("rebalance", "part")
     .sortWithinPartitions("part", "tag", "bucket").write.partitionBy("part").parquet(path))
    tagged.sparkSession.createDataFrame([(partitions,)], "partitions int").coalesce(1).write.json(f"{path}-properties")


def ids_of(bitmaps: DataFrame) -> DataFrame:
    """doc_id of every bit that is set in rows (bucket, bits)."""
    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, bits in zip(batch.column(0).to_pylist(), batch.column(1)):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), bitorder="little"))
                ids = (bucket - 1) * RANGE + at + 1 if bucket > 0 else bucket * RANGE - at  # as Spark numbers them
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["doc_id"])
    return bitmaps.select("bucket", "bits").mapInArrow(unpacked, "doc_id long")


def flipped(bits: Column) -> Column:
    """All bits turned over, byte by byte: the hex digits of a byte and of its complement mirror each other."""
    return F.unhex(F.translate(F.hex(bits), "0123456789ABCDEF", "FEDCBA9876543210"))


def with_tags(spark: SparkSession, path: str, any_of: list[str] | None = None, all_of: list[str] | None = None,
              none_of: list[str] | None = None) -> DataFrame:
    """doc_id of the documents that have one of `any_of` (if given), every one of `all_of` and none of `none_of`."""
    wanted, forbidden = set(all_of or []), set(none_of or [])
    if EVERY in wanted | forbidden | set(any_of or []):
        raise ValueError("a tag needs at least one character")
    partitions = spark.read.json(f"{path}-properties").first()["partitions"]
    asked = sorted({EVERY} | wanted | forbidden | set(any_of or []))
    parts = spark.range(1).select(F.array_distinct(F.array(*[part_of(F.lit(t), partitions) for t in asked]))).first()[0]
    rows = spark.read.schema(INDEX).parquet(path).where(F.col("part").isin(parts) & F.col("tag").isin(asked))

    def either(tags: set) -> Column:
        return F.when(F.col("tag").isin(sorted(tags)), F.col("bits"))
    have = [F.bitmap_and_agg(either(wanted | {EVERY})).alias("wanted"),
            F.count(either(wanted)).alias("n"),
            F.bitmap_or_agg(either(set(any_of or []) or {EVERY})).alias("offered"),
            F.bitmap_or_agg(either(forbidden)).alias("forbidden"),
            F.max(F.col("tag") == EVERY).alias("there")]
    ranges = rows.groupBy("bucket").agg(*have).where((F.col("n") == len(wanted)) & F.col("there"))
    sides = F.array("wanted", "offered", flipped(F.col("forbidden")))
    return ids_of(ranges.select("bucket", F.explode(sides).alias("bits")).groupBy("bucket").agg(
        F.bitmap_and_agg("bits").alias("bits")))
