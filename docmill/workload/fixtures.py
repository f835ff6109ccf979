"""The given tables, and columns derived from them the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.chunking import chunk

NOW = 1_700_000_000
EPOCH = 1_704_067_200
ZERO_TIME = "1970-01-01 00:00:00"  # without a zone, so results do not depend on the session's
NL = "\n"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents; files of a single row group are dealt to all cores, as only a test table needs it.

    The always-true partition test keeps Catalyst from moving costly filters below the
    exchange, back into the one task of the scan.
    """
    docs, cores = table(spark, sf, "documents"), spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() >= cores:
        return docs
    return docs.repartition(cores, "doc_id").where(F.spark_partition_id() >= 0)


def acl():
    return (F.when(F.col("lang") == "en", "public").when(F.col("lang").isin("fr", "de"), "team"))


def written_at():
    return F.when(F.col("source") != "src7", F.lit(EPOCH) + F.col("doc_id") * 60)


def described(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with acl, ts, version and a modification time."""
    return documents(spark, sf).select(
        "doc_id", "text", "lang", "source", "n_chars", acl().alias("acl"), written_at().alias("ts"),
        F.concat(F.lit("v_"), "source").alias("version"),
        (F.lit(ZERO_TIME).cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(EPOCH) + F.col("n_chars"))).alias(
            "last_modified"))


def line_chunks(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    """Non-empty lines as chunks, with the document columns asked for."""
    return chunk(described(spark, sf), "paragraph_clean", ("doc_id", *keep), sep=NL)


# ---- the same in SQL --------------------------------------------------------------------

DESCRIBED = f"""described AS (
  SELECT doc_id, text, lang, source, n_chars,
         CASE WHEN lang = 'en' THEN 'public' WHEN lang IN ('fr', 'de') THEN 'team' END AS acl,
         CASE WHEN source <> 'src7' THEN {EPOCH} + doc_id * 60 END AS ts,
         'v_' || source AS version, to_timestamp({EPOCH} + n_chars) AT TIME ZONE 'UTC' AS last_modified
  FROM documents)"""

SQL_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SQL_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
SQL_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
SQL_SENTENCES = (r"string_split(regexp_replace(" + SQL_STRIP
                 + r", '([.!?]) +', '\1' || chr(1), 'g'), chr(1))")

LINES = DESCRIBED + f""",
line_parts AS (
  SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda p: {SQL_STRIP.format('p')}),
                        lambda p: p <> '') AS parts
  FROM described),
lines AS (
  SELECT d.* EXCLUDE (text, parts), CAST(i - 1 AS INTEGER) AS chunk_id, parts[i] AS chunk
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM line_parts) d)"""


def rows_of(parts: str, source: str = "documents") -> str:
    """Explode a list expression over `source` into (doc_id, chunk_id, chunk)."""
    return f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_id, parts[i] AS chunk
FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
      FROM (SELECT doc_id, {parts} AS parts FROM {source}))"""
