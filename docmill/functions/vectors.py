"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.text import let, run_length, run_starts, tokens

EMBED_DIM = 64


def hashed_counts(text: Column, dim: int = EMBED_DIM) -> Column:
    """Bag of words hashed to `dim` buckets: first 32 bits of md5(token) modulo dim.

    Returns (bucket, n) pairs in bucket order, counted by runs of the sorted buckets.
    """
    bucket = F.transform(
        tokens(text),
        lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim).cast("int"))
    return let(F.sort_array(bucket), lambda b: let(
        run_starts(b, lambda x: x),
        lambda starts: F.transform(starts, lambda s, j: F.struct(
            F.get(b, s).alias("bucket"),
            run_length(starts, s, j, F.size(b)).alias("n")))))


def hashed_embedding(text: Column, dim: int = EMBED_DIM) -> Column:
    """The built-in text vector: hashed counts divided by their L2 norm (zeros for no tokens)."""
    def dense(pairs: Column) -> Column:
        norm = F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x["n"] * x["n"]))
        by_bucket = F.map_from_entries(pairs)
        return let(F.struct(by_bucket.alias("m"), norm.alias("norm")), lambda v: F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: F.coalesce(v["m"][i] / v["norm"], F.lit(0.0))))

    return let(hashed_counts(text, dim), dense)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when a side has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")),
        F.lit(0.0), lambda acc, d: acc + d * d)
