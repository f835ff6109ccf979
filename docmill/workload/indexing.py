"""Index maintenance: inserts, upserts, state, plans, cache and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions.records import vector_id
from docmill.functions import text as T
from docmill.operators import assembly, index
from docmill.plans import reindex
from docmill.session import scratch_path, staged
from docmill.sources import documents as sources, tables
from docmill.workload.fixtures import DESCRIBED, LINES, NL, NOW, described, documents, line_chunks, table
from docmill.workload.registry import query
from docmill.workload.textual import KEYWORD_CTE, LEAD

# Stored state by language: en current and whole, fr old version and half, de current version
# but interrupted half-way, es unknown. The first line of every fr document was edited since.
STATE = """sizes AS (SELECT doc_id, max(chunk_id) + 1 AS n FROM lines GROUP BY doc_id),
state AS (SELECT l.doc_id, CASE WHEN lang = 'fr' THEN 'v_old' ELSE version END AS version, chunk_id,
    sha256(CASE WHEN lang = 'fr' AND chunk_id = 0 THEN chunk || ' (old)' ELSE chunk END) AS chunk_hash
  FROM lines l JOIN sizes USING (doc_id)
  WHERE lang = 'en' OR (lang IN ('fr', 'de') AND chunk_id * 2 < n))"""


def versioned_lines(spark, sf):
    """Line chunks with version, language and the number of lines, counted in the row."""
    from docmill.operators.chunking import clean_paragraphs
    docs = described(spark, sf).withColumn("parts", clean_paragraphs(F.col("text"), NL))
    return docs.select("doc_id", "lang", "version", F.size("parts").alias("n"),
                       F.posexplode("parts").alias("chunk_id", "chunk"))


def stored_state(spark, sf):
    rows = versioned_lines(spark, sf).where("lang = 'en' or (lang in ('fr', 'de') and chunk_id * 2 < n)")
    old = F.col("lang") == "fr"
    text = F.when(old & (F.col("chunk_id") == 0), F.concat("chunk", F.lit(" (old)"))).otherwise(F.col("chunk"))
    return rows.select("doc_id", F.when(old, "v_old").otherwise(F.col("version")).alias("version"), "chunk_id",
                       index.chunk_hash(text).alias("chunk_hash"))


PLAN_CODE = """todo AS (SELECT l.doc_id, l.chunk_id, l.chunk, l.version FROM lines l
  LEFT JOIN (SELECT doc_id, max(version) AS stored FROM state GROUP BY doc_id) v USING (doc_id)
  WHERE v.stored IS DISTINCT FROM l.version
    AND NOT EXISTS (SELECT 1 FROM state s WHERE s.doc_id = l.doc_id AND s.chunk_id = l.chunk_id))"""


@query(f"WITH {LINES}, {STATE}, {PLAN_CODE} SELECT doc_id, chunk_id, chunk FROM todo")
def reindex_plan_code(spark, sf):
    """Version first, then chunk numbers: interrupted documents count as done."""
    todo = reindex.to_index(described(spark, sf), stored_state(spark, sf), "code", strategy="paragraph_clean", sep=NL)
    return todo.select("doc_id", "chunk_id", "chunk")


@query(f"""WITH {LINES}, {STATE} SELECT l.doc_id, l.chunk_id, l.chunk FROM lines l WHERE NOT EXISTS (
  SELECT 1 FROM state s WHERE s.doc_id = l.doc_id AND s.chunk_id = l.chunk_id AND s.chunk_hash = sha256(l.chunk))""")
def reindex_plan_hash(spark, sf):
    """Number and text of every chunk: resumes interrupted documents, notices edits."""
    todo = reindex.to_index(described(spark, sf), stored_state(spark, sf), "hash", strategy="paragraph_clean", sep=NL)
    return todo.select("doc_id", "chunk_id", "chunk")


@query(f"""WITH {LINES}, {STATE}
SELECT d.doc_id, d.version FROM described d LEFT JOIN (SELECT doc_id, max(version) AS stored FROM state GROUP BY doc_id) v
  USING (doc_id) WHERE v.stored IS DISTINCT FROM d.version""")
def version_compare(spark, sf):
    """Documents whose stored version is not their version."""
    return index.changed_documents(described(spark, sf), stored_state(spark, sf)).select("doc_id", "version")


@query(f"""WITH {LINES}, {STATE} SELECT d.doc_id, d.version, coalesce(string_agg(chunk_id, ',' ORDER BY chunk_id), '') AS indexed
FROM described d LEFT JOIN state s USING (doc_id) GROUP BY d.doc_id, d.version""")
def reindex_dry_run(spark, sf):
    out = reindex.dry_run(described(spark, sf), stored_state(spark, sf))
    return out.withColumn("indexed", F.array_join(F.col("indexed").cast("array<string>"), ","))


@query(f"""WITH {LINES}, {STATE} SELECT d.doc_id, coalesce(max(s.version), 'none') AS version,
  CAST(count(DISTINCT chunk_id) AS BIGINT) AS chunks_indexed_count
FROM described d LEFT JOIN state s USING (doc_id) GROUP BY d.doc_id""")
def index_progress(spark, sf):
    out = index.progress(stored_state(spark, sf), described(spark, sf))
    return out.withColumn("version", F.coalesce("version", F.lit("none")))


@query(f"""WITH {LINES}, {STATE}, {PLAN_CODE}
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM todo) THEN 'v_' || source ELSE version END AS version,
       chunk_id, chunk_hash
FROM (SELECT s.*, d.source FROM state s JOIN documents d USING (doc_id))
UNION ALL SELECT doc_id, version, chunk_id, sha256(chunk) FROM todo""")
def state_after_reindex(spark, sf):
    """State with the newly indexed chunk numbers added under the new version."""
    state = stored_state(spark, sf)
    todo = reindex.to_index(described(spark, sf), state, "code", strategy="paragraph_clean", sep=NL)
    return index.merged_state(state, staged(todo.select("doc_id", "version", "chunk_id", "chunk"), "todo"))


@query(f"""WITH {LINES}, {STATE} SELECT doc_id, chunk_id FROM lines EXCEPT SELECT doc_id, chunk_id FROM state""")
def missing_chunks(spark, sf):
    return index.missing_by_id(versioned_lines(spark, sf), stored_state(spark, sf)).select("doc_id", "chunk_id")


# ---- upserts ----------------------------------------------------------------------------

# Stored: every line of en, fr and de documents. Updates: fr and es lines, twice (batch 1, 2).
UPSERT = """stored AS (SELECT doc_id || '_chunk_' || chunk_id AS vector_id, doc_id, chunk_id, chunk, 0 AS batch
  FROM lines WHERE lang IN ('en', 'fr', 'de')),
updates AS (SELECT doc_id || '_chunk_' || chunk_id AS vector_id, doc_id, chunk_id, 'second ' || chunk AS chunk, 2 AS batch
  FROM lines WHERE lang IN ('fr', 'es'))"""


def _stored_and_updates(spark, sf):
    rows = index.with_vector_id(line_chunks(spark, sf, "lang"))
    columns = ["vector_id", "doc_id", "chunk_id", "chunk", "batch"]
    stored = rows.where("lang in ('en', 'fr', 'de')").withColumn("batch", F.lit(0)).select(*columns)
    changed = rows.where("lang in ('fr', 'es')")
    first = changed.withColumn("batch", F.lit(1)).withColumn("chunk", F.concat(F.lit("first "), "chunk"))
    second = changed.withColumn("batch", F.lit(2)).withColumn("chunk", F.concat(F.lit("second "), "chunk"))
    return stored, first.unionByName(second).select(*columns)


UPSERTED = f"""WITH {LINES}, {UPSERT} SELECT * FROM stored WHERE vector_id NOT IN (SELECT vector_id FROM updates)
UNION ALL SELECT * FROM updates"""


@query(UPSERTED)
def index_upsert(spark, sf):
    stored, updates = _stored_and_updates(spark, sf)
    return index.upserted(stored, updates, ["vector_id"], ["batch"])


@query(UPSERTED)
def index_upsert_table(spark, sf):
    """The same through a table in the shared folder, of which the touched partitions are overwritten."""
    stored, updates = _stored_and_updates(spark, sf)
    kept = tables.Keyed(spark, scratch_path(spark, "upsert"), ("vector_id",), buckets=8)
    kept.create(stored)
    kept.upsert(updates, ["batch"])
    return kept.read()


@query(f"WITH {LINES}, {UPSERT} SELECT vector_id, chunk_id FROM stored WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def index_delete_table(spark, sf):
    """Delete the labelled documents from a partitioned table."""
    stored, _ = _stored_and_updates(spark, sf)
    kept = tables.Keyed(spark, scratch_path(spark, "delete"), ("vector_id",), buckets=8)
    kept.create(stored)
    kept.delete(table(spark, sf, "labels"))
    return kept.read().select("vector_id", "chunk_id")


@query(f"WITH {LINES}, {UPSERT} SELECT vector_id, chunk_id, chunk FROM stored WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def chunk_lookup_table(spark, sf):
    """The chunks of some documents out of a table: only the partitions of these documents are read."""
    stored, _ = _stored_and_updates(spark, sf)
    kept = tables.Keyed(spark, scratch_path(spark, "lookup"), ("vector_id",), buckets=64)
    kept.create(stored)
    return kept.read(table(spark, sf, "labels").where("toxic = 1")).select("vector_id", "chunk_id", "chunk")


@query(f"""WITH {LINES}, {UPSERT} SELECT vector_id, chunk_id FROM stored
WHERE NOT starts_with(vector_id, '1_chunk_') AND NOT starts_with(vector_id, '23_')""")
def index_delete_prefix_table(spark, sf):
    """Delete two documents by the prefix of their ids, one of them with its owner known."""
    stored, _ = _stored_and_updates(spark, sf)
    kept = tables.Keyed(spark, scratch_path(spark, "prefix"), ("vector_id",), buckets=8)
    kept.create(stored)
    kept.delete_prefix("1_chunk_")
    kept.delete_prefix("23_", owners=spark.createDataFrame([(23,)], "doc_id long"))
    return kept.read().select("vector_id", "chunk_id")


@query(f"""WITH {LINES} SELECT CASE WHEN lang = 'es' THEN 'chunk_' || chunk_id ELSE doc_id || '_chunk_' || chunk_id END AS vector_id,
  CASE WHEN lang = 'es' THEN 'default_collection' ELSE CAST(doc_id AS VARCHAR) END AS collection, doc_id
FROM lines QUALIFY row_number() OVER (PARTITION BY vector_id, collection ORDER BY doc_id DESC) = 1""")
def vector_upsert(spark, sf):
    """Rows without metadata share the default collection; the last document wins there."""
    known = F.col("lang") != "es"
    meta = F.when(known, F.create_map(
        F.lit("vector_id"), vector_id(F.col("doc_id"), F.col("chunk_id")),
        F.lit("document_id"), F.col("doc_id").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = index.vector_rows(line_chunks(spark, sf, "lang").withColumn("metadata", meta))
    out = index.latest(rows, ["vector_id", "collection"], ["doc_id"])
    return out.select("vector_id", "collection", "doc_id")


@query(f"""WITH {LINES} SELECT md5(chunk) AS digest, CASE WHEN lang = 'en' THEN CAST(doc_id AS VARCHAR) ELSE '' END AS source_doc,
  CAST({NOW} AS BIGINT) AS ts, coalesce(acl, 'public') AS acl, CASE WHEN lang = 'fr' THEN 'bm' ELSE '' END AS bm25 FROM lines""")
def index_insert(spark, sf):
    """Collection rows with the declared defaults for missing metadata."""
    rows = line_chunks(spark, sf, "acl", "lang").select(
        F.lit(None).cast("array<float>").alias("embedding"), F.col("chunk").alias("summary"), "acl",
        F.when(F.col("lang") == "en", F.col("doc_id").cast("string")).alias("source_doc"),
        F.when(F.col("lang") == "fr", "bm").alias("bm25"))
    return index.insert_rows(rows, NOW).select(F.md5("summary").alias("digest"), "source_doc", "ts", "acl", "bm25")


@query(f"""WITH {LINES} SELECT doc_id, chunk_id, CAST(coalesce(ts, {NOW}) AS BIGINT) AS ts FROM lines WHERE lang <> 'fr'
UNION ALL SELECT doc_id, chunk_id, CAST({NOW} AS BIGINT) FROM lines WHERE lang = 'fr' AND chunk_id < 2""")
def cache_write(spark, sf):
    """Cached chunks get a time; re-caching fr documents with two chunks leaves no old tail."""
    rows = line_chunks(spark, sf, "ts", "lang").drop("chunk")
    again = rows.where("lang = 'fr' and chunk_id < 2").withColumn("ts", F.lit(None).cast("bigint"))
    cached = index.replaced(index.cache_rows(rows, NOW), index.cache_rows(again, NOW))
    return cached.select("doc_id", "chunk_id", "ts")


CATALOG = f"""{DESCRIBED}, {KEYWORD_CTE}, catalog AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, source AS doc_name,
  {LEAD.format('d.text')} AS summary, keywords AS keyword, strftime(last_modified, '%Y-%m-%dT%H:%M:%S') AS last_modified,
  coalesce(acl, 'public') AS acl, 'local' AS storage, '2024-01-01T00:00:00' AS created_at
FROM described d JOIN kw ON kw.doc_id = d.doc_id)"""


def _catalog(spark, sf):
    docs = described(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("doc_name"),
        T.lead(F.col("text")).alias("summary"), T.top_keywords(F.col("text")).alias("keyword"), "last_modified",
        "acl", F.lit("local").alias("storage"), F.lit(None).cast("string").alias("bm25"),
        F.lit(None).cast("timestamp").alias("created_at"))
    return tables.catalog_rows(docs, "2024-01-01 00:00:00")


def _catalog_shown(rows):
    from docmill.functions.records import iso_time
    return rows.select("id", "doc_name", "summary", T.joined_keywords(F.col("keyword")).alias("keyword"),
                       iso_time(F.col("last_modified")).alias("last_modified"), "acl", "storage",
                       iso_time(F.col("created_at")).alias("created_at"))


@query(f"WITH {CATALOG} SELECT * FROM catalog")
def catalog_write(spark, sf):
    """Document catalog rows, written to a table and read back."""
    path = scratch_path(spark, "catalog")
    tables.append(_catalog(spark, sf), path)
    return _catalog_shown(sources.table_documents(spark, path))


@query(f"WITH {CATALOG} SELECT * REPLACE (CASE WHEN id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) THEN doc_name || ' (new)' "
       "ELSE doc_name END AS doc_name) FROM catalog")
def catalog_upsert(spark, sf):
    """The catalog written twice: labelled documents change, no document is listed twice."""
    rows = _catalog(spark, sf)
    listed = tables.Keyed(spark, scratch_path(spark, "catalog"), ("id",), "id", 8)
    listed.upsert(rows)
    labelled = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    changed = rows.join(labelled, "id", "left_semi").withColumn("doc_name", F.concat("doc_name", F.lit(" (new)")))
    listed.upsert(changed)
    return _catalog_shown(listed.read())


@query("""SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'cache' ELSE 'generated' END AS source
FROM documents""")
def cache_split(spark, sf):
    """Labelled documents are cached, the others have to be generated."""
    hits, misses = index.split_cached(
        documents(spark, sf).select("doc_id", F.lit(True).alias("use_cache")), table(spark, sf, "labels"))
    return hits.select("doc_id", F.lit("cache").alias("source")).unionByName(
        misses.select("doc_id", F.lit("generated").alias("source")))


@query(f"""WITH {LINES}, sizes AS (SELECT doc_id, max(chunk_id) + 1 AS n FROM lines GROUP BY doc_id)
SELECT doc_id, chunk_id, md5(chunk) AS digest, CAST(length(chunk) AS INTEGER) AS size FROM lines JOIN sizes USING (doc_id)
WHERE chunk_id * 2 < n""")
def zip_vectors(spark, sf):
    """Chunks with vectors by position, cut to the shorter side (half of each document)."""
    rows = versioned_lines(spark, sf)
    sizes = rows.where("chunk_id * 2 < n").select("doc_id", "chunk_id", F.length("chunk").alias("size"))
    return assembly.zipped(rows.select("doc_id", "chunk_id", F.md5("chunk").alias("digest")), sizes)


STATUS = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' END"


def upload_events(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.expr(STATUS).alias("status"), "ts", F.col("event_id").alias("seq")).where(
        "status is not null")


@query(f"""SELECT user_id AS doc_id, {STATUS} AS status FROM events WHERE {STATUS} IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def upload_status(spark, sf):
    return index.latest_status(upload_events(spark, sf))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def doc_list_scan(spark, sf):
    """An id list with padding and blank lines, written as text, read back and applied."""
    path = scratch_path(spark, "ids")
    lines = table(spark, sf, "labels").select(F.explode(F.array(
        F.concat(F.lit(" \t"), F.col("doc_id").cast("string"), F.lit(" ")), F.lit("   "), F.lit(""))).alias("value"))
    lines.write.text(path)
    return sources.listed(documents(spark, sf), sources.id_list(spark, path)).select("doc_id", "n_chars")

