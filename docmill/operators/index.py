"""Index maintenance as set operations: what to index, what to drop, what the table becomes.

State is a table of rows (doc_id, version, chunk_id, chunk_hash), not a value per document,
so the largest document is spread over the cluster like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.records import DEFAULT_ACL, DEFAULT_COLLECTION, vector_id
from docmill.session import staged

UNKNOWN_VERSION = "unknown"


def chunk_hash(chunk: Column) -> Column:
    return F.sha2(chunk, 256)


def stored_versions(state: DataFrame) -> DataFrame:
    """One version per document; combined map-side, one row per document and task."""
    return state.groupBy("doc_id").agg(F.max("version").alias("stored_version"))


def changed_documents(docs: DataFrame, state: DataFrame) -> DataFrame:
    """Documents whose stored version differs from their own (a missing one counts as unknown)."""
    current = docs.withColumn("version", F.coalesce("version", F.lit(UNKNOWN_VERSION)))
    changed = (current.select("doc_id", "version").join(stored_versions(state), "doc_id", "left")
               .where(~F.col("stored_version").eqNullSafe(F.col("version"))).select("doc_id"))
    return chosen(current, changed, ["doc_id"])


def chosen(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """Rows with one of the keys. The keys are compared without the texts and staged: Catalyst
    then knows their size, and texts are only shuffled when the keys are too many to broadcast."""
    return rows.join(staged(keys, "keys"), by, "left_semi")


def missing_by_id(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """Chunks whose number is not in the state (a changed text under an old number is kept)."""
    keys = ["doc_id", "chunk_id"]
    return chosen(chunks, chunks.select(*keys).join(state.select(*keys), keys, "left_anti"), keys)


def missing_keys(hashed: DataFrame, state: DataFrame) -> DataFrame:
    """(doc_id, chunk_id) whose number and text are not in the state: resumes and notices edits."""
    keys = ["doc_id", "chunk_id", "chunk_hash"]
    return hashed.select(*keys).join(state.select(*keys), keys, "left_anti").select("doc_id", "chunk_id")


def state_rows(indexed: DataFrame) -> DataFrame:
    hashed = F.col("chunk_hash") if "chunk_hash" in indexed.columns else chunk_hash(F.col("chunk"))
    return indexed.select("doc_id", "version", "chunk_id", hashed.alias("chunk_hash"))


def merged_state(state: DataFrame, indexed: DataFrame) -> DataFrame:
    """State after indexing: the document's new version, the union of its chunk numbers."""
    fresh = state_rows(indexed)
    kept = state.join(fresh.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti")
    versions = fresh.groupBy("doc_id").agg(F.max("version").alias("_new"))
    kept = kept.join(versions, "doc_id", "left").withColumn(
        "version", F.coalesce("_new", "version")).drop("_new")
    return kept.select(*fresh.columns).unionByName(fresh)


def progress(state: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, version, chunks_indexed_count); documents without state have no version and 0."""
    done = state.groupBy("doc_id").agg(
        F.max("version").alias("version"), F.countDistinct("chunk_id").alias("chunks_indexed_count"))
    if docs is None:
        return done
    return docs.select("doc_id").join(done, "doc_id", "left").withColumn(
        "chunks_indexed_count", F.coalesce("chunks_indexed_count", F.lit(0)))


def dry_run(docs: DataFrame, state: DataFrame) -> DataFrame:
    """What a reindex would find: current version and the chunk numbers already indexed, sorted."""
    have = state.groupBy("doc_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("indexed"))
    return docs.select("doc_id", F.coalesce("version", F.lit(UNKNOWN_VERSION)).alias("version")).join(
        have, "doc_id", "left").withColumn("indexed", F.coalesce("indexed", F.array().cast("array<int>")))


# ---- upserts ----------------------------------------------------------------------------


def latest(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last update per key; Spark keeps one row per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return updates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def single(updates: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key where no order is given: equal rows count as one, unequal ones are an error."""
    w = Window.partitionBy(*keys)
    marked = updates.withColumn("_row", F.xxhash64(F.to_json(F.struct(*updates.columns))))
    marked = marked.withColumn("_n", F.row_number().over(w.orderBy("_row"))).withColumn(
        "_same", F.min("_row").over(w) == F.max("_row").over(w))
    refused = F.raise_error(F.lit("several updates of one key need an order")).cast("int")
    return marked.where(F.when(F.col("_same"), F.col("_n")).otherwise(refused) == 1).drop("_row", "_n", "_same")


def upserted(existing: DataFrame, updates: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Existing rows not in the updates, plus the updates. Only keys are compared.

    Of several updates of a key the last in `order` counts; without an order they must be equal.
    """
    kept = existing.join(updates.select(*keys), keys, "left_anti").select(*existing.columns)
    new = latest(updates, keys, order) if order else single(updates, keys)
    return kept.unionByName(new.select(*existing.columns))


def replaced(existing: DataFrame, new: DataFrame, owner: str = "doc_id",
             owners: DataFrame | None = None) -> DataFrame:
    """All rows of the owners (by default those in `new`) give way to `new`: no old tail remains."""
    gone = (new if owners is None else owners).select(owner).distinct()
    kept = existing.join(gone, owner, "left_anti")
    return kept.select(*existing.columns).unionByName(new.select(*existing.columns))


def insert_rows(chunks: DataFrame, now: Column | int) -> DataFrame:
    """Rows of the summary collection, with the declared defaults."""
    now = F.lit(now) if isinstance(now, int) else now
    return chunks.select(
        "embedding", "summary", F.coalesce("source_doc", F.lit("")).alias("source_doc"),
        now.cast("bigint").alias("ts"), F.coalesce("acl", F.lit(DEFAULT_ACL)).alias("acl"),
        F.coalesce("bm25", F.lit("")).alias("bm25"))


def cache_rows(chunks: DataFrame, now: int) -> DataFrame:
    """Cached chunks keep their time; a missing one becomes now."""
    return chunks.withColumn("ts", F.coalesce("ts", F.lit(now).cast("bigint")))


def vector_rows(chunks: DataFrame) -> DataFrame:
    """Upsert rows keyed by metadata.vector_id, with the defaults for missing metadata."""
    meta = F.col("metadata")
    return chunks.withColumn("vector_id", F.coalesce(
        meta["vector_id"], F.concat(F.lit("chunk_"), F.col("chunk_id").cast("string")))).withColumn(
        "collection", F.coalesce(meta["document_id"], F.lit(DEFAULT_COLLECTION)))


def split_cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with cached chunks (unless they opt out of the cache), and the others."""
    have = cache.select("doc_id").distinct()
    wants = requests.where(F.coalesce("use_cache", F.lit(True)))
    hits = wants.join(have, "doc_id", "left_semi")
    misses = wants.join(have, "doc_id", "left_anti").unionByName(
        requests.where(~F.coalesce("use_cache", F.lit(True))))
    return hits, misses


def cached_documents(cache: DataFrame) -> DataFrame:
    return cache.select("doc_id").distinct()


def latest_status(events: DataFrame) -> DataFrame:
    """Last status per document by (ts, seq)."""
    return events.groupBy("doc_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"))


def with_vector_id(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("vector_id", vector_id(F.col("doc_id"), F.col("chunk_id")))
