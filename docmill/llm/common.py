"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters \x20 and \x09-\x0D, in that order.
SPACES = " \t\n\x0b\x0c\r"
#: Byte table that lower-cases A-Z and leaves every other byte, also of longer UTF-8 characters.
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_rows(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns), doc_id and text, so that no column an operator adds meets one of the table's."""
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.struct(*columns).alias("row"), "doc_id", "text")


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3: rows of fold 1 are held out from learning. Null ids: 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 1
