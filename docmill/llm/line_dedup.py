"""Line dedup by levelled sorted runs of line hashes.

A run is a table bucketed and sorted by a 128-bit line hash, with one row per hash: the number of
documents that hold the line and the largest of their ids. Every batch of documents adds one run
at level 0; `fanout` runs of a level are merged into one run of the next level, so a store of n
batches holds at most fanout * log(n) runs. All runs have the same buckets, so runs are merged
bucket by bucket with a full outer merge join, without an exchange, and a batch is judged by a
merge anti join in which only the batch's lines move: a line goes when the runs show it in at
least `min_docs` documents with a larger id among them.

Whether a line is in `min_docs` documents is known only after the last batch, so `dedup_lines`
adds all batches first and then judges them one by one; `LineRuns` by itself serves batches that
arrive over time. Lines that go are fewer than lines that stay, so these are what meets the texts again.

A line that a large part of all documents holds would send all its rows to one bucket. Lines with
at least one in HEAVY of all pairs of line and document are at most HEAVY by number; they are
broadcast, and their rows are judged where they are.

Defined results: a null or empty text is one empty line. Lines whose key has fewer than
`min_chars` code points always stay. Rows without an id count for nothing and stay as they are.
Rows that share an id are one document: they count once per line and are each returned. Columns
other than the id and the text are not looked at; `apply` carries them along whatever their names
are. Empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docmill.llm.common import SPACES, lowered, whole_rows
from docmill.session import scratch_path

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2
KEYS = ("line1", "line2")
#: Lines that hold more than one in HEAVY of all pairs of line and document: 240 kB.
HEAVY = 10_000
RUN = "line1 long, line2 long, n_docs long, last_doc long"


def line_key(line: Column) -> Column:
    """What makes two lines equal: white space stripped at both ends, A-Z in lower case."""
    return lowered(F.trim(line, F.lit(SPACES)))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, version (hash of the text), pos, line1, line2: one row per line that can be dropped."""
    lines = docs.where("doc_id IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("version"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    key = lines.select("doc_id", "version", "pos", line_key(F.col("line")).alias("line"))
    return key.where(F.length("line") >= min_chars).select(
        "doc_id", "version", "pos", F.xxhash64("line").alias("line1"),
        F.xxhash64(F.lit(1), "line").alias("line2"))


class LineRuns:
    """Levelled sorted runs in the shared folder; batches must not share documents."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def _written(self, run: DataFrame) -> DataFrame:
        """The run as a bucketed table; its files stay when its name leaves the catalog again."""
        path = scratch_path(self.spark, "line-run")
        name = "line_run_" + path.rsplit("-", 1)[1]
        run.write.bucketBy(self.buckets, *KEYS).sortBy(*KEYS).option("path", path).saveAsTable(name)
        table = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return table

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def _one(self, runs: list[DataFrame]) -> DataFrame:
        """One written run out of several, merged two by two."""
        while len(runs) > 1:
            runs = [self._written(merged(*runs[:2])), *runs[2:]]
        return runs[0]

    def add(self, lines: DataFrame) -> None:
        """Add the lines of a new batch as one run, then merge the levels that are full."""
        run = lines.groupBy(*KEYS).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        self._put(self._written(run.repartition(self.buckets, *KEYS)), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(self._one(full), level + 1)
            level += 1

    def whole(self) -> DataFrame:
        """All runs as one: line1, line2, n_docs, last_doc."""
        runs = [run for level in self.levels for run in level]
        return self._one(runs) if runs else self.spark.createDataFrame([], RUN)

    def judge(self, min_docs: int = MIN_DOCS) -> Judge:
        return Judge(self.whole(), min_docs)


class Judge:
    """What all runs together say about the lines of any batch."""

    def __init__(self, run: DataFrame, min_docs: int = MIN_DOCS):
        pairs = run.agg(F.sum("n_docs")).first()[0] or 0
        common = F.col("n_docs") * HEAVY >= F.lit(pairs)
        self.frequent = run.where(F.col("n_docs") >= min_docs)
        self.heavy = self.frequent.where(common).select(*KEYS, "last_doc")  # at most HEAVY rows
        self.light = self.frequent.where(~common).select(*KEYS, "last_doc")

    def surviving(self, lines: DataFrame) -> DataFrame:
        """Merge anti join: the lines of a batch that no run gives to a document of larger id."""
        return self._judged(lines, "left_anti", "a.doc_id >= b.last_doc")

    def dropped(self, lines: DataFrame) -> DataFrame:
        """The other side of `surviving`: the lines that go."""
        return self._judged(lines, "left_semi", "a.doc_id < b.last_doc")

    def _judged(self, lines: DataFrame, how: str, kept: str) -> DataFrame:
        same = "a.line1 = b.line1 AND a.line2 = b.line2"
        batch, heavy, light = lines.alias("a"), F.broadcast(self.heavy).alias("b"), self.light.hint("merge").alias("b")
        common = batch.join(heavy, F.expr(same)).where(kept).select("a.*")
        rest = batch.join(heavy, F.expr(same), "left_anti").alias("a")
        return rest.join(light, F.expr(f"{same} AND a.doc_id < b.last_doc"), how).unionByName(common)


def merged(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two runs as one, by a merge join of equal buckets.

    Not a union: Spark 4.1.2 takes a union of bucketed tables for bucketed, and groups each by itself.
    """
    a, b = one.alias("a"), two.hint("merge").alias("b")
    n_docs = [F.coalesce(f"{t}.n_docs", F.lit(0)) for t in "ab"]
    return a.join(b, F.expr("a.line1 = b.line1 AND a.line2 = b.line2"), "full").select(
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in KEYS], (n_docs[0] + n_docs[1]).alias("n_docs"),
        F.greatest("a.last_doc", "b.last_doc").alias("last_doc"))


@F.pandas_udf(StringType())
def without_lines(text: pd.Series, gone: pd.Series) -> pd.Series:
    def kept(whole, positions):
        if positions is None or not len(positions):
            return whole
        drop = set(positions)
        return "\n".join(line for i, line in enumerate(whole.split("\n")) if i not in drop)
    return pd.Series([kept(t, g) for t, g in zip(text, gone)], dtype=object)


def judged_rows(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """The rows of `docs` (row, doc_id, text) with `line_hash_version` and `lines_gone`, the positions of lines that go."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "lines")
    lines = line_hashes(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    parts = [lines.where(F.col("batch") == batch).drop("batch") for batch in range(batches)]
    runs = LineRuns(spark, fanout)
    for part in parts:
        runs.add(part)
    judge = runs.judge(min_docs)
    gone = reduce(DataFrame.unionByName, [judge.dropped(part) for part in parts]).groupBy(
        "doc_id", F.col("version").alias("line_hash_version")).agg(F.collect_set("pos").alias("lines_gone"))
    # an id is null on neither side of a match, so rows without one pass through the left join
    return docs.withColumn("line_hash_version", F.xxhash64("text")).join(gone, ["doc_id", "line_hash_version"], "left")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, kept_text, n_lines (before), n_dropped: one row per row of `docs` (doc_id, text)."""
    rows = judged_rows(docs.select(F.lit(0).alias("row"), "doc_id", "text"), min_chars, min_docs, batches, fanout)
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id", without_lines(text, F.col("lines_gone")).alias("kept_text"),
        F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines_gone"), F.lit(0)).cast("long").alias("n_dropped"))


def apply(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
          batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """`docs` with the kept lines as text and `n_chars` counted again; texts that lose nothing stay as they are."""
    rows = judged_rows(whole_rows(docs), min_chars, min_docs, batches, fanout)
    kept = rows.withColumn("kept", without_lines(F.coalesce("text", F.lit("")), F.col("lines_gone")))
    row = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType))
    return kept.select(F.when(F.col("lines_gone").isNull(), F.col("row")).otherwise(row).alias("row")).select("row.*")
