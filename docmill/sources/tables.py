"""Table sinks: appends, stream batches, and keyed tables on partitioned Parquet.

A keyed table is plain Parquet, partitioned by a hash of the document (or session) that owns a row.
A change reads the partitions it touches, stages what becomes of them and lets Spark's dynamic
partition overwrite put them in place; all other partitions are neither read nor written.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from docmill.functions.records import DEFAULT_ACL
from docmill.functions.text import BLANK_LINE
from docmill.operators.index import latest, replaced, single
from docmill.session import staged
from docmill.sources.documents import FILE_FOLDER, FILE_NAME

FILE_FOLDERS = 256
NO_ID = "__HIVE_DEFAULT_PARTITION__"
#: Characters that a file name cannot hold everywhere.
ESCAPED = re.compile(r"[\x00-\x1f\x7f\"#%'*+/:=?\\{}\[\]^<>|]")
BUCKET = "bucket"
BUCKETS = 16_384  # about 6 GB each for a 100 TB table; small tables pass fewer
CODEC = "zstd"  # keyed tables hold a chunk, its summary, vector and hash: a quarter smaller than by snappy


def upload(docs: DataFrame, path: str) -> DataFrame:
    """Append documents under new ids, split by storage; returns the rows written."""
    rows = docs.withColumn("doc_id", F.uuid()).withColumn("storage", F.coalesce("storage", F.lit("local")))
    rows.write.mode("append").partitionBy("storage").parquet(path)
    return docs.sparkSession.read.parquet(path)


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of an address; addresses without a scheme are local."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", address))


def write_text_files(docs: DataFrame, path: str, replace: bool = False) -> None:
    """One text file per document, in one of `FILE_FOLDERS` folders; every text ends in a newline.

    Rows that share an id are one file, their texts one after the other; rows without an id are too, under the name
    Spark gives a partition without a value. With `replace` the documents' files give way to the new ones,
    and those of other documents stay as they are. The tasks write through `pyarrow.fs`, a file under another
    name first: a folder per file, as Spark's writer makes them, takes some 50 times as long.
    """
    spark = docs.sparkSession
    files, target = _files(spark, path)
    if not replace and files.exists(target):
        raise FileExistsError(path)
    files.mkdirs(target)
    name = F.coalesce(F.nullif(F.col("doc_id").cast("string"), F.lit("")), F.lit(NO_ID))
    rows = docs.select(name.alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    folder = F.format_string(f"{FILE_FOLDER}%02x", F.pmod(F.xxhash64("name"), F.lit(FILE_FOLDERS)))
    rows.repartition("name").sortWithinPartitions("name", "text").select(folder.alias("folder"), "name", "text").mapInArrow(
        _write_files(path), "files long").agg(F.sum("files")).collect()


def _write_files(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        last, out, there, count = None, None, set(), 0

        def put() -> None:
            out.close()
            store.move(draft, final)

        for batch in batches:
            for folder, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                if name != last:
                    if out is not None:
                        put()
                    if folder not in there:
                        store.create_dir(f"{root}/{folder}", recursive=True)
                        there.add(folder)
                    safe = ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", name)
                    final = f"{root}/{folder}/{FILE_NAME}{safe}.txt"
                    draft = f"{root}/{folder}/.{uuid.uuid4().hex}"  # a hidden name, which no scan reads
                    last, out, count = name, store.open_output_stream(draft), count + 1
                out.write(text.encode() + b"\n")
        if out is not None:
            put()
        yield pa.RecordBatch.from_pydict({"files": [count]})

    return run


def write_summaries(chunks: DataFrame, path: str) -> None:
    """Summaries as text in (doc_id, chunk_id) order, blank line between; no document is assembled."""
    keys = ["doc_id", "chunk_id"]
    (chunks.where("summary <> ''").select(*keys, "summary")
     .repartitionByRange(*keys).sortWithinPartitions(*keys)
     .select("summary").write.option("lineSep", BLANK_LINE).text(path))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def catalog_rows(docs: DataFrame, now: str) -> DataFrame:
    """Rows of the document catalog with the declared defaults."""
    return docs.select(
        "id", "doc_name", "summary", "keyword", "last_modified",
        F.coalesce("acl", F.lit(DEFAULT_ACL)).alias("acl"), "storage", "bm25",
        F.coalesce("created_at", F.lit(now).cast("timestamp")).alias("created_at"))


def write_jdbc(df: DataFrame, url: str, table: str, **properties: str) -> None:
    """Optional copy of a catalog to a database, over connections the tasks open."""
    df.write.jdbc(url, table, mode="append", properties=properties)


def write_lists(assigned: DataFrame, path: str) -> None:
    """Vectors laid out by inverted list, so a search reads only the lists it probes.

    `rebalance` spreads a list that holds much of the table over several tasks and files.
    """
    assigned.hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(path)


# ---- batch folders of a stream ----------------------------------------------------------


def write_batch(df: DataFrame, path: str, batch_id: int, owners: DataFrame | None = None) -> None:
    """Write a micro-batch to its own folder; running the batch again replaces the folder.

    `owners` are all documents of the batch, also those that have no rows in it.
    """
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    if owners is not None:
        owners.write.mode("overwrite").parquet(f"{path}-owners/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, owner: str) -> DataFrame:
    """Rows of the newest batch of each owner, so a document that came again has no old rows."""
    rows = spark.read.parquet(path)
    seen = spark.read.parquet(f"{path}-owners") if exists(spark, f"{path}-owners") else rows
    newest = seen.groupBy(owner).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, [owner, "batch_id"], "left_semi").drop("batch_id")


# ---- keyed tables -----------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _files(spark, path)
    return files.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    files, target = _files(spark, path)
    files.delete(target, True)


def bucket_of(owner: str = "doc_id", buckets: int = BUCKETS) -> Column:
    """The partition of a row: a hash of the owning document (or session)."""
    return F.pmod(F.xxhash64(F.col(owner).cast("string")), F.lit(buckets)).cast("int")


def bucketed(df: DataFrame, buckets: int = BUCKETS, owner: str = "doc_id") -> DataFrame:
    """Add the partition column."""
    return df.withColumn(BUCKET, bucket_of(owner, buckets))


@dataclass(frozen=True)
class Keyed:
    """The table in folder `path`: Parquet partitions in `rows`, one empty file with its columns in `columns`.

    `keys` tell rows apart; without them rows belong to their owner only. A change is staged whole
    in `pending` before a stored file is touched. From then on readers take the touched partitions
    from there, so a change that stops half-way is either not there at all or there as a whole, and
    the next change first finishes it. One writer at a time; a reader that has begun before a
    change may miss its files and has to begin again. The work of a change grows with the size
    of the touched partitions: `buckets` should leave them a few GB each.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...] = ()
    owner: str = "doc_id"
    buckets: int = BUCKETS

    def exists(self) -> bool:
        return exists(self.spark, f"{self.path}/columns/_SUCCESS")

    def read(self, owners: DataFrame | None = None) -> DataFrame:
        """The rows; of the given documents (or sessions) only, if there are any: then no other partition is read."""
        rows = self._stored(None if owners is None else self._buckets_of(owners)).drop(BUCKET)
        if owners is None:
            return rows
        return rows.join(owners.select(self.owner).distinct(), self.owner, "left_semi").select(*rows.columns)

    def create(self, df: DataFrame) -> None:
        """Write a new table, or what is left of one whose creation failed."""
        self._write(df, f"{self.path}/rows")
        df.limit(0).write.mode("overwrite").parquet(f"{self.path}/columns")

    def upsert(self, updates: DataFrame, order: list[str] | None = None, gone: DataFrame | None = None,
               written: bool = False) -> None:
        """Insert or replace rows by key, and drop those with the keys and owners in `gone`; creates the table on first use.

        Of several updates of a key the last in `order` counts; without an order they must be equal. Updates that
        are `written`, that is staged already, are not written once more.
        """
        keys = list(self.keys)
        updates = staged(latest(updates, keys, order), "updates") if order else self._single(updates, written)
        if not self.exists():
            self.create(updates)
            return
        touched, old = updates.select(self.owner), updates.select(*keys)
        if gone is not None:
            touched, old = touched.unionByName(gone.select(self.owner)), old.unionByName(gone.select(*keys))

        def merged(rows: DataFrame) -> DataFrame:
            kept = rows.join(old, keys, "left_anti").select(*rows.columns)
            return kept.unionByName(updates.select(*rows.columns))
        self._change(touched, merged)

    def replace(self, rows: DataFrame, owners: DataFrame | None = None, written: bool = False) -> None:
        """Replace all rows of the documents (or sessions) in `rows`, or of the `owners` given.

        An owner without new rows loses its old ones. Rows that are `written`, that is staged already, are not written
        once more.
        """
        if not self.exists():
            self.create(rows)
            return
        rows = rows if written else staged(rows, "replacement")
        owners = staged((rows if owners is None else owners).select(self.owner).distinct(), "owners")
        touched = owners.unionByName(rows.select(self.owner))
        self._change(touched, lambda stored: replaced(stored, rows, self.owner, owners))

    def delete(self, owners: DataFrame) -> None:
        """Drop every row of the given documents (or sessions)."""
        if self.exists():
            gone = staged(owners.select(self.owner).distinct(), "owners")
            self._change(gone, lambda rows: rows.join(gone, self.owner, "left_anti").select(*rows.columns))

    def delete_keys(self, rows: DataFrame) -> None:
        """Drop the rows with the keys of `rows`, which also holds their owners."""
        if self.exists():
            keys = list(self.keys)
            gone = staged(rows.select(*dict.fromkeys([self.owner, *keys])).distinct(), "gone")
            self._change(gone, lambda stored: stored.join(gone.select(*keys), keys, "left_anti").select(*stored.columns))

    def delete_prefix(self, prefix: str, column: str = "vector_id", owners: DataFrame | None = None) -> None:
        """Drop rows whose id starts with a literal prefix. Only ids are read to find them; of the `owners`, if given."""
        if self.exists():
            self.delete_keys(self.read(owners).where(F.col(column).startswith(prefix)))

    # ---- partitions

    def _single(self, updates: DataFrame, written: bool) -> DataFrame:
        """One row per key, staged. Keys are counted first: only where one comes twice do whole rows move."""
        updates = updates if written else staged(updates, "updates")
        if updates.groupBy(*self.keys).count().where("count > 1").isEmpty():
            return updates
        return staged(single(updates, list(self.keys)), "single")

    def _buckets_of(self, owners: DataFrame) -> list[int]:
        """At most `buckets` numbers come to the driver."""
        numbers = bucketed(owners.select(self.owner), self.buckets, self.owner).select(BUCKET).distinct()
        return sorted(r[0] for r in numbers.collect())

    def _columns(self) -> StructType:
        return self.spark.read.parquet(f"{self.path}/columns").schema

    def _part(self, folder: str) -> DataFrame:
        return self.spark.read.schema(self._columns().add(BUCKET, IntegerType())).parquet(f"{self.path}/{folder}")

    def _stored(self, only: list[int] | None = None) -> DataFrame:
        rows, waiting = self._part("rows"), self._waiting()
        if waiting:
            rows = rows.where(~F.col(BUCKET).isin(waiting)).unionByName(self._part("pending/rows"))
        return rows if only is None else rows.where(F.col(BUCKET).isin(only))

    def _write(self, df: DataFrame, path: str) -> None:
        """`rebalance` splits a hot bucket over tasks and joins small ones."""
        rows = bucketed(df, self.buckets, self.owner).hint("rebalance", BUCKET)
        rows.write.mode("overwrite").option("compression", CODEC).partitionBy(BUCKET).parquet(path)

    def _waiting(self) -> list[int]:
        """The partitions of a change that is staged as a whole but not in place yet."""
        if not exists(self.spark, f"{self.path}/pending/touched/_SUCCESS"):
            return []
        return [r[0] for r in self.spark.read.parquet(f"{self.path}/pending/touched").collect()]

    def _change(self, touched: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> None:
        self.finish()
        hit = self._buckets_of(touched)
        if not hit:
            return
        self._write(merge(self._stored(hit).drop(BUCKET)), f"{self.path}/pending/rows")
        numbers = self.spark.createDataFrame([(b,) for b in hit], f"{BUCKET} int")
        numbers.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pending/touched")
        self.finish()

    def finish(self) -> None:
        """Put a staged change in place; what was staged only in part goes away. Can be run again at any time."""
        waiting = self._waiting()
        if waiting:
            rows = self._part("pending/rows")
            filled = {r[0] for r in rows.select(BUCKET).distinct().collect()}
            # the staged files are laid out as they shall be, so their rows are copied and not dealt once more
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", CODEC).partitionBy(
                BUCKET).parquet(f"{self.path}/rows")
            for empty in set(waiting) - filled:  # an overwrite leaves partitions alone that get no row
                remove(self.spark, f"{self.path}/rows/{BUCKET}={empty}")
        remove(self.spark, f"{self.path}/pending/touched")
        remove(self.spark, f"{self.path}/pending")
