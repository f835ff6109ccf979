"""Documents to index rows: gate, chunk, summarize, key, embed, describe.

With built-in engines the whole plan is one narrow stage over the scan: nothing shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import records, text as text_fn, vectors
from docmill.operators import chunking, inference, quality
from docmill.operators.index import cache_rows, chunk_hash, split_cached
from docmill.session import staged

Embed = Callable[[Column], Column]


def gated(docs: DataFrame, judges: list[Column] | None = None, min_chars: int | None = quality.MIN_CHARS,
          flags: DataFrame | None = None) -> DataFrame:
    """Documents that may be indexed. `flags` (doc_id, flagged) comes from external judges."""
    kept = docs.where(quality.passes(quality.flagged_by(judges or []), F.length("text"), min_chars))
    if flags is not None:  # only the flagged ids are needed; unknown documents pass
        kept = kept.join(staged(flags.where("flagged").select("doc_id"), "flagged"), "doc_id", "left_anti")
    return kept


def described(docs: DataFrame, keyword_limit: int = text_fn.KEYWORD_COUNT, mode: str = "fallback") -> DataFrame:
    """Add the document-level metadata that is repeated on every chunk, with defaults."""
    answer = F.col("keyword_answer") if mode == "llm" else None
    have = docs.columns
    default = {"acl": F.lit(records.DEFAULT_ACL), "bm25": F.lit(""), "version": F.lit("unknown")}
    for name, value in default.items():
        docs = docs.withColumn(name, F.coalesce(F.col(name), value) if name in have else value)
    if "last_modified" not in have:
        docs = docs.withColumn("last_modified", F.lit(None).cast("timestamp"))
    return docs.withColumn("keywords", text_fn.joined_keywords(
        text_fn.keywords(F.col("text"), mode, answer, keyword_limit)))


def chunk_rows(docs: DataFrame, strategy: str = "paragraph", keep: tuple[str, ...] = (), **options) -> DataFrame:
    meta = ["doc_id", "acl", "bm25", "version", "keywords", "last_modified", *keep]
    return chunking.chunk(docs, strategy, tuple(meta), **options)


def embedded(chunks: DataFrame, embed: Embed = vectors.hashed_embedding, column: str = "chunk") -> DataFrame:
    return chunks.withColumn("embedding", embed(F.col(column)))


def finished(chunks: DataFrame, now: int) -> DataFrame:
    """The index table: one row per chunk, keyed by vector_id."""
    doc = F.col("doc_id").cast("string")
    return chunks.select(
        records.vector_id(F.col("doc_id"), F.col("chunk_id")).alias("vector_id"), "doc_id", "chunk_id",
        "chunk", "summary", "embedding", doc.alias("source_doc"), "acl", "bm25", "keywords", "version",
        records.iso_time(F.col("last_modified")).alias("last_modified"),
        F.lit(now).cast("bigint").alias("ts"), chunk_hash(F.col("chunk")).alias("chunk_hash"))


def ingest(docs: DataFrame, now: int, *, judges: list[Column] | None = None,
           flags: DataFrame | None = None, min_chars: int | None = quality.MIN_CHARS,
           strategy: str = "paragraph", options: dict | None = None, summarizer="lead",
           functions: dict | None = None, embed: Embed = vectors.hashed_embedding,
           keyword_mode: str = "fallback") -> DataFrame:
    """The index rows of all documents that pass the gate."""
    ready = described(gated(docs, judges, min_chars, flags), mode=keyword_mode)
    chunks = chunk_rows(ready, strategy, **(options or {}))
    return finished(embedded(inference.summarize(chunks, summarizer, functions), embed), now)


def summarize_requests(requests: DataFrame, docs: DataFrame, cache: DataFrame, now: int, **settings) -> DataFrame:
    """Chunks for each request: cached ones where there are any, new ones otherwise; `source` says which.

    The cheap test comes first: only requests without cached chunks are chunked and summarized.
    A document that several requests ask for is returned once per source. Its acl and bm25 are
    those of the request (of several the smallest), else the document's own.
    """
    hits, misses = split_cached(requests, cache)
    hits = staged(hits.select("doc_id").distinct(), "cached")
    own = [c for c in ("acl", "bm25") if c in misses.columns]
    wanted = staged(misses.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(f"_{c}") for c in own]),
                    "wanted")
    found = docs.join(wanted, "doc_id")
    for c in own:
        found = found.withColumn(c, F.coalesce(f"_{c}", c) if c in docs.columns else F.col(f"_{c}"))
    new = ingest(found.drop("_n", *[f"_{c}" for c in own]), now, min_chars=None, **settings)
    columns = ["doc_id", "chunk_id", "summary", "acl", "ts"]
    old = cache_rows(cache, now).join(hits, "doc_id", "left_semi")
    return (old.select(*columns, F.lit("cache").alias("source"))
            .unionByName(new.select(*columns, F.lit("generated").alias("source"))))
