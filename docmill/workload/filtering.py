"""Lookups, filters, deletes, limits and conversation windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import assembly, filters, index, ranking
from docmill.operators.chunking import chunks_of
from docmill.session import scratch_path
from docmill.sources import tables
from docmill.workload.fixtures import (EPOCH, LINES, NL, SQL_SENTENCES, SQL_TOKENS, described,
                                       documents, line_chunks, table)
from docmill.workload.registry import query
from docmill.workload.textual import FOUND_WORDS, KEYWORD_CTE

LATER = EPOCH + 3000


@query(f"WITH {LINES} SELECT doc_id, chunk_id, chunk FROM lines WHERE doc_id IN (SELECT doc_id FROM labels)")
def chunk_lookup(spark, sf):
    """All chunks of the labelled documents."""
    return filters.of_documents(line_chunks(spark, sf), table(spark, sf, "labels"))


def _summaries(spark, sf):
    """Line chunks as cached summaries with acl and time."""
    return line_chunks(spark, sf, "acl", "ts").withColumnRenamed("chunk", "summary")


HITS = f"""hits AS (SELECT doc_id, chunk_id, chunk AS summary FROM lines
  WHERE acl = 'public' AND contains(lower(coalesce(chunk, '')), 'the')
    AND coalesce(ts, 0) >= {LATER} AND coalesce(ts, 0) <= {EPOCH + 50_000_000})"""


def _hits(spark, sf):
    return filters.matching(_summaries(spark, sf), "The", "public", LATER, EPOCH + 50_000_000).select(
        "doc_id", "chunk_id", "summary")


@query(f"""WITH {LINES}, {HITS}, n AS (SELECT count(*) AS n FROM hits)
SELECT doc_id, chunk_id, summary, CAST(rk AS INTEGER) AS rank FROM
  (SELECT *, row_number() OVER (ORDER BY doc_id, chunk_id) AS rk FROM hits), n
WHERE rk <= greatest(floor(n * 0.2), 1) AND rk <= 100""")
def chunk_search_keyword(spark, sf):
    """Keyword, access and time filter; the first fifth of the hits, at most 100."""
    return ranking.limited(_hits(spark, sf), ["doc_id", "chunk_id"], 100, 0.2)


@query(f"""WITH {LINES}, {HITS}, n AS (SELECT count(*) AS n FROM hits)
SELECT doc_id, chunk_id, summary, rk AS rank FROM
  (SELECT *, row_number() OVER (ORDER BY doc_id, chunk_id) AS rk FROM hits), n
WHERE rk <= greatest(floor(n * 0.5), 1)""")
def chunk_search_share(spark, sf):
    """The first half of all hits, without a count limit."""
    return ranking.limited(_hits(spark, sf), ["doc_id", "chunk_id"], None, 0.5)


QUESTIONS = f"""ask_words AS (SELECT item_id, w, count(*) AS n, min(i) AS first FROM (
  SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (
    SELECT item_id, {FOUND_WORDS} AS ws FROM benchmark)) GROUP BY item_id, w),
top_word AS (SELECT item_id, w FROM ask_words QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, first) = 1),
asked AS (SELECT item_id AS qid, coalesce(w, '') AS keyword,
  CASE WHEN length(text) > 200 THEN 'public' END AS acl,
  CASE WHEN length(text) > 150 THEN {LATER} ELSE 0 END AS min_time,
  CASE WHEN length(text) > 180 THEN {EPOCH + 40_000} END AS max_time FROM benchmark LEFT JOIN top_word USING (item_id))"""


def questions(spark, sf):
    """Benchmark texts as requests: the most frequent word as the keyword, other filters by length."""
    size = F.length("text")
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), "text", F.get(T.top_keywords(F.col("text"), 1), F.lit(0)).alias("keyword"),
        F.when(size > 200, "public").alias("acl"),
        F.when(size > 150, LATER).otherwise(0).alias("min_time"),
        F.when(size > 180, EPOCH + 40_000).alias("max_time"))


@query(f"""WITH {LINES}, {QUESTIONS}
SELECT qid, doc_id, chunk_id, CAST(rk AS INTEGER) AS rank FROM (
  SELECT a.qid, l.doc_id, l.chunk_id, row_number() OVER (PARTITION BY a.qid ORDER BY l.doc_id, l.chunk_id) AS rk
  FROM asked a JOIN lines l ON contains(lower(l.chunk), lower(a.keyword)) AND (a.acl IS NULL OR l.acl = a.acl)
   AND (a.min_time = 0 OR coalesce(l.ts, 0) >= a.min_time) AND (a.max_time IS NULL OR coalesce(l.ts, 0) <= a.max_time))
WHERE rk <= 20""")
def chunk_search_batch(spark, sf):
    """The same search for a table of requests, 20 hits each."""
    hits = filters.matching_queries(_summaries(spark, sf), questions(spark, sf), k=20)
    return ranking.limited(hits.drop("matched"), ["doc_id", "chunk_id"], 20, None, "qid")


@query(f"""SELECT doc_id, n_chars FROM documents
WHERE contains(' ' || array_to_string({SQL_TOKENS.format('text')}, ' ') || ' ', ' with the ')""")
def phrase_search(spark, sf):
    return filters.with_phrase(documents(spark, sf), "With, the").select("doc_id", "n_chars")


@query(f"""WITH {KEYWORD_CTE} SELECT DISTINCT doc_id FROM kw_rank WHERE rk <= 10 AND w IN ('with', 'avec', 'that')""")
def tag_filter(spark, sf):
    tagged = documents(spark, sf).select("doc_id", T.top_keywords(F.col("text")).alias("keywords"))
    return filters.with_any_tag(tagged, ["with", "avec", "that"]).select("doc_id")


WIDTHS = {"text": 4096, "lang": 1, "source": 4}


@query(" UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS \"column\", CAST(length({c}) AS INTEGER) AS size, {w} AS width FROM documents "
    f"WHERE length({c}) > {w}" for c, w in WIDTHS.items()))
def column_limits(spark, sf):
    return filters.width_violations(documents(spark, sf), WIDTHS, "doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) >= 100")
def length_gate(spark, sf):
    return filters.long_enough(documents(spark, sf)).select("doc_id", "n_chars")


@query(f"WITH {LINES} SELECT doc_id, chunk_id FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def delete_document(spark, sf):
    return filters.without_documents(line_chunks(spark, sf), table(spark, sf, "labels"))\
        .select("doc_id", "chunk_id")


@query(f"""WITH {LINES} SELECT doc_id || '_chunk_' || chunk_id AS vector_id FROM lines
WHERE NOT starts_with(doc_id || '_chunk_' || chunk_id, '1_chunk_')""")
def delete_prefix(spark, sf):
    """Drop the vectors of document 1 by prefix; '1_' must not match 10, 11, ..."""
    ids = index.with_vector_id(line_chunks(spark, sf)).select("vector_id")
    return filters.without_prefix(ids, "1_chunk_")


@query(f"""WITH {LINES}, {KEYWORD_CTE}
SELECT l.doc_id, l.chunk_id, CAST(l.doc_id AS VARCHAR) AS source_doc, coalesce(l.acl, 'public') AS acl, '' AS bm25,
  kw.keywords, strftime(l.last_modified, '%Y-%m-%dT%H:%M:%S') AS last_modified
FROM lines l JOIN kw ON kw.doc_id = l.doc_id""")
def chunk_metadata(spark, sf):
    from docmill.functions.records import iso_time
    from docmill.plans.ingest import chunk_rows, described as with_metadata
    rows = chunk_rows(with_metadata(described(spark, sf)), "paragraph_clean", sep=NL)
    return rows.select("doc_id", "chunk_id", F.col("doc_id").cast("string").alias("source_doc"), "acl", "bm25",
                       "keywords", iso_time(F.col("last_modified")).alias("last_modified"))


@query(f"""WITH {LINES} SELECT doc_id, CAST(count(*) AS BIGINT) AS summary_count FROM lines GROUP BY doc_id""")
def summary_count(spark, sf):
    return line_chunks(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("summary_count"))


@query(f"WITH {LINES} SELECT DISTINCT doc_id FROM lines")
def cached_docs(spark, sf):
    return index.cached_documents(line_chunks(spark, sf))


@query(f"""WITH {LINES} SELECT doc_id, CAST(count(*) AS INTEGER) AS chunks, string_agg(chunk, '|' ORDER BY chunk_id) AS parts
FROM lines GROUP BY doc_id""")
def document_arrays(spark, sf):
    """Chunks back into one ordered array per document."""
    whole = assembly.collected(line_chunks(spark, sf), "chunk")
    return whole.select("doc_id", "chunks", F.array_join("chunk", "|").alias("parts"))


@query(f"""WITH {LINES}, s AS (SELECT doc_id, chunk_id, {SQL_SENTENCES.format('chunk')}[1] AS summary FROM lines)
SELECT d.doc_id, coalesce(string_agg(s.summary, chr(10) || chr(10) ORDER BY chunk_id), '') AS summary
FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id""")
def document_summaries(spark, sf):
    """First sentence of every line, joined; all inside the document's row."""
    lines = chunks_of(F.col("text"), "paragraph_clean", sep=NL)
    return documents(spark, sf).select("doc_id", T.join_summaries(
        F.transform(lines, lambda c: T.lead(c, 1))).alias("summary"))


def messages(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


@query("""SELECT session_id, seq, role, content, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS INTEGER) AS position
FROM (SELECT conv_id AS session_id, turn AS seq, role, text AS content FROM conversations
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)""")
def conversation_last_n(spark, sf):
    return ranking.last_messages(messages(spark, sf), 3)


@query(f"""SELECT conv_id AS session_id, role, md5(text) AS digest, {EPOCH} + turn * 30 AS ts,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations""")
def conversation_append(spark, sf):
    """Messages numbered per session by time, whatever the size of a session."""
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), "role", F.md5("text").alias("digest"),
        (F.lit(EPOCH) + F.col("turn") * 30).alias("ts"))
    return ranking.ordinals(rows, ["session_id"], ["ts"], "seq")


@query(f"""SELECT conv_id AS session_id, role, md5(text) AS digest, {EPOCH} + turn * 30 AS ts,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations""")
def conversation_append_existing(spark, sf):
    """Later messages go on from the number their session has reached; new sessions begin at one."""
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), "role", F.md5("text").alias("digest"), "turn",
        (F.lit(EPOCH) + F.col("turn") * 30).alias("ts"))
    old = (F.col("turn") < 2) & (F.col("session_id") % 3 > 0)
    path = scratch_path(spark, "conversations")
    tables.append(ranking.ordinals(rows.where(old).drop("turn"), ["session_id"], ["ts"], "seq"), path)
    tables.append(ranking.appended(spark.read.parquet(path), rows.where(~old).drop("turn")), path)
    return spark.read.parquet(path).select("session_id", "role", "digest", "ts", "seq")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN "
       "(SELECT conv_id FROM conversations WHERE role = 'system')")
def session_clear(spark, sf):
    """Clear every conversation that has a system message."""
    rows = table(spark, sf, "conversations")
    return filters.without_documents(rows, rows.where("role = 'system'"), "conv_id").select("conv_id", "turn", "role")

