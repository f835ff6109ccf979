"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the
columns of `documents`, extra ones of any name included; the last returns packed pieces. An empty table gives an
empty result in every stage. Between stages the rows are written as
Parquet to the shared folder and read again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docmill.llm import decontamination, line_dedup, packing, quality_model, simhash
from docmill.llm.common import table
from docmill.llm.queries import vocabulary
from docmill.session import staged

#: Packing cannot be said in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def of_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null texts count as empty; an empty text is scored like any other. Every row is judged by itself, repeated
    ones and those without an id too. Without labels nothing is rejected.
    """
    return quality_model.apply(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that at least three documents hold, which stay in the last of these.

    A null text stays null. Rows that share an id are one document; rows without an id stay as they are.
    """
    return line_dedup.apply(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Null and wordless texts are copies of each other. Of rows that share id and text one stays; all rows without an id stay.
    """
    return simhash.apply(docs)


def without_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by test phrases.

    Null and wordless texts are clean, as is everything without test phrases. Repeated rows are judged each.
    """
    return decontamination.apply(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, as pieces of near-full token sequences.

    A null or empty text is its end id alone. Rows without an id and repeated rows are packed each.
    """
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_classifier", of_good_quality),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
