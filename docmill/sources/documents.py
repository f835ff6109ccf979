"""Reading documents: whole text files, tables, id lists."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.records import iso_time
from docmill.functions.text import strip
from docmill.session import scratch_path

#: How `tables.write_text_files` names folders and files.
FILE_FOLDER, FILE_NAME = "id_hash=", "doc-"
#: What opening a small file counts in a scan: some thousand share a task.
OPEN_COST = 1 << 16
#: Settings of a scan of small files: its folders are listed by tasks, and the driver does not keep their lists for later scans.
SMALL_FILES = {"spark.sql.files.openCostInBytes": OPEN_COST, "spark.sql.sources.parallelPartitionDiscovery.threshold": 1,
               "spark.sql.hive.filesourcePartitionFileCacheSize": 0}
#: Files that the driver lists at a time, some KB each, in a scan by parts; a path of more folders is one part.
FILES_AT_ONCE, MOST_FOLDERS = 1 << 16, 10_000

STORAGES = {"s3": "s3a", "azure": "abfss", "local": "file"}  # fixed values: storage -> URI scheme


def storage_of(path: Column) -> Column:
    """Storage name from the URI scheme of a path column."""
    kind = F.when(path.startswith("s3"), "s3").when(path.startswith("abfs"), "azure")
    return kind.otherwise("local")


def unescaped(name: Column) -> Column:
    """`%20` and the like as characters; a plus sign is one, and a name that is not escaped stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside reads many small files in a task; by default a task would take 32 of them at most."""
    before = {name: spark.conf.get(name) for name in SMALL_FILES}
    for name, value in SMALL_FILES.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def parts(spark: SparkSession, path: str | list[str]) -> list[list]:
    """The `name=value` folders of a path (as Hadoop paths, by name) in parts of at most `FILES_AT_ONCE` files; a fuller folder is one part.

    Empty where one part is enough, or none can be made: files are in no such folder, or `path` is a pattern or a list.
    """
    if not isinstance(path, str) or re.search(r"[*?\[{]", path):
        return []
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    folders, entries = {}, files.listStatusIterator(root)
    while entries.hasNext():
        entry = entries.next()
        folder = entry.getPath()
        name = folder.getName()
        if name.startswith(".") or name.startswith("_") and "=" not in name:  # no scan reads these
            continue
        if "=" not in name or not entry.isDirectory() or len(folders) == MOST_FOLDERS:
            return []
        folders[f"{folder.toUri().getRawPath()}/"] = folder
    with ThreadPoolExecutor(4) as pool:
        counts = pool.map(lambda key: (key, files.getContentSummary(folders[key]).getFileCount()), sorted(folders))
        found, held = [], 0
        for key, count in counts:
            if not found or held + count > FILES_AT_ONCE:
                found.append([])
                held = 0
            found[-1].append(folders[key])
            held += count
    return found if len(found) > 1 else []


def scanned(spark: SparkSession, path: str | list[str], label: str, scan: Callable[[str | list[str]], DataFrame]) -> DataFrame:
    """What `scan` makes of the files below `path`, staged. It gets the path in `parts`, so the driver lists no more files at a time."""
    return _by_parts(spark, label, path, parts(spark, path), lambda some, _: scan(some))


def _by_parts(spark: SparkSession, label: str, path: str | list[str], found: list[list], scan: Callable) -> DataFrame:
    """The rows of `scan`, which gets the folders of a part and a condition on the paths of its files."""
    out, place = scratch_path(spark, label), F.regexp_replace("path", "^[^:/]+:(//[^/]*)?", "")
    with small_files(spark):
        for part in found or [None]:
            if part is None:
                rows = scan(path, F.lit(True))
            else:  # by name a part is a range; 0 is the character behind a slash
                first, last = (folder.toUri().getRawPath() for folder in (part[0], part[-1]))
                rows = scan([folder.toString() for folder in part], (place >= f"{first}/") & (place < f"{last}0"))
            rows.write.mode("append").parquet(out)
            schema = rows.schema
            del rows
            gc.collect()  # Py4J's objects refer to themselves; until Python collects them, the driver keeps the part's list
    return spark.read.schema(schema).parquet(out)


def escaped_id(path: Column) -> Column:
    """The id in the path of a file of `tables.write_text_files`, or that of a `doc_id=` directory; escaped twice, else ''."""
    written = F.regexp_extract(path, rf"/{FILE_FOLDER}[0-9a-f]+/{FILE_NAME}([^/]+)\.txt$", 1)
    return F.when(written != "", written).otherwise(F.regexp_extract(path, r"/doc_id=([^/]+)/", 1))


def file_id() -> Column:
    """The file name without its extension, or the id for which a file or a `doc_id=` directory was written.

    The metadata give names as in a URI; the writers have escaped the id once more.
    """
    meta = F.col("_metadata")
    folder = escaped_id(meta["file_path"])
    return F.when(folder != "", unescaped(unescaped(folder))).otherwise(
        F.regexp_replace(unescaped(meta["file_name"]), r"\.[^.]*$", ""))


def file_text() -> Column:
    """The whole text of a file, with every line end as a newline."""
    return F.regexp_replace("value", r"\r\n?", "\n")


def text_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One document per file: (doc_id, text, storage, path, last_modified).

    An empty file gives no row: Spark reads nothing from it, and no gate would pass it.
    """
    meta = F.col("_metadata")
    files = spark.read.text(path, wholetext=True)
    return files.select(
        file_id().alias("doc_id"), file_text().alias("text"),
        storage_of(meta["file_path"]).alias("storage"), meta["file_path"].alias("path"),
        meta["file_modification_time"].alias("last_modified"))


def listed_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, last_modified) of all files that hold something, staged; they are listed in `parts`, and their contents not read."""
    def scan(some):
        meta, files = F.col("_metadata"), spark.read.format("binaryFile").load(some)
        return files.where("length > 0").select(
            meta["file_path"].alias("path"), meta["file_modification_time"].alias("last_modified"))

    return scanned(spark, path, "listed", scan)


def file_changes(spark: SparkSession, path: str | list[str], seen: DataFrame) -> DataFrame:
    """(path, last_modified, change): what differs from the files `seen` (path, last_modified) by an earlier scan.

    `change` is 'new', 'changed' (another time of modification, an older one too) or 'gone'; `last_modified`
    is the present time, or the last known one of files that are gone. Only paths and times are joined.
    """
    now, before = listed_files(spark, path).alias("now"), seen.select("path", "last_modified").distinct().alias("before")
    both = now.join(before, F.expr("now.path = before.path"), "full")
    change = (F.when(F.col("now.path").isNull(), "gone").when(F.col("before.path").isNull(), "new")
              .when(F.col("now.last_modified") != F.col("before.last_modified"), "changed"))
    return both.select(F.coalesce("now.path", "before.path").alias("path"),
                       F.coalesce("now.last_modified", "before.last_modified").alias("last_modified"),
                       change.alias("change")).where("change IS NOT NULL")


def changed_documents(spark: SparkSession, path: str | list[str], changes: DataFrame,
                      each: Callable[[DataFrame], DataFrame] = lambda docs: docs) -> DataFrame:
    """`each` of `text_documents` of the files that `changes` (see `file_changes`, staged) calls new or changed.

    Files outside the span of their times are pruned before any is opened: Spark applies a filter on
    `_metadata` to the list of files. The files left are joined with the changes, so that an
    unchanged one inside the span gives no row; texts in the span move only where Spark finds the
    changes too large to broadcast. Small files share a task. Where the files make several `parts`, each is read
    with the changes in it, and what `each` makes of it is staged.
    """
    todo = changes.where("change <> 'gone'").select("path", "last_modified")

    def read(some, inside):
        here = todo.where(inside)
        first, last = here.agg(F.min(F.unix_micros("last_modified")), F.max(F.unix_micros("last_modified"))).first()
        docs = text_documents(spark, some)
        if first is None:
            return each(docs.limit(0))
        span = F.col("last_modified").between(F.timestamp_micros(F.lit(first)), F.timestamp_micros(F.lit(last)))
        return each(docs.where(span).join(here, ["path", "last_modified"], "left_semi"))

    found = parts(spark, path)
    return _by_parts(spark, "changed", path, found, read) if found else read(path, F.lit(True))


def table_documents(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A table of documents; any format on the class path (delta needs its jar)."""
    return spark.read.format(fmt).options(**options).load(path)


def with_modified(docs: DataFrame) -> DataFrame:
    return docs.withColumn("last_modified_iso", iso_time(F.col("last_modified")))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Document ids from a text file: one per line, stripped, blank lines dropped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("doc_id")).where("doc_id <> ''")


def listed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Only the listed documents."""
    return docs.join(ids.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct(),
                     "doc_id", "left_semi")
