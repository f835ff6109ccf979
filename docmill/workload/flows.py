"""Whole flows: ingest, refine, reindex, cached requests."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import quality
from docmill.operators.inference import Expression
from docmill.plans import ingest, refine, reindex
from docmill.session import scratch_path
from docmill.sources import tables
from docmill.workload.fixtures import LINES, NL, NOW, SQL_SENTENCES, SQL_TOKENS, described, line_chunks, table
from docmill.workload.registry import query
from docmill.workload.scrutiny import VOTES, flags
from docmill.workload.textual import KEYWORD_CTE, LEAD, SCORE, extractive_sql


FIRST_SENTENCE = Expression(lambda chunk: T.lead(chunk, 1))


SUMMARY = f"{SQL_SENTENCES.format('l.chunk')}[1]"
EMBEDDING_SUM = f"""sums AS (SELECT doc_id, chunk_id, round(sum(n) / sqrt(sum(n * n)), 6) AS total FROM (
  SELECT doc_id, chunk_id, b, count(*) AS n FROM (
    SELECT doc_id, chunk_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b
    FROM (SELECT doc_id, chunk_id, unnest({SQL_TOKENS.format('chunk')}) AS w FROM lines)) GROUP BY ALL)
  GROUP BY doc_id, chunk_id)"""
INGESTED = f"""{LINES}, {VOTES}, {KEYWORD_CTE}, {EMBEDDING_SUM},
ingested AS (SELECT l.doc_id || '_chunk_' || l.chunk_id AS vector_id, {SUMMARY} AS summary, coalesce(l.acl, 'public') AS acl,
  kw.keywords, strftime(l.last_modified, '%Y-%m-%dT%H:%M:%S') AS last_modified, CAST({NOW} AS BIGINT) AS ts,
  coalesce(total, 0.0) AS embedding_total
FROM lines l JOIN votes v ON v.doc_id = l.doc_id AND v.n_chars >= 100 AND NOT v.votes > 1.5
JOIN kw ON kw.doc_id = l.doc_id LEFT JOIN sums s ON s.doc_id = l.doc_id AND s.chunk_id = l.chunk_id)"""
SHOWN = ["vector_id", "summary", "acl", "keywords", "last_modified", "ts", "embedding_total"]


def shown(rows):
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6)
    return rows.withColumn("embedding_total", total).select(*SHOWN)


@query(f"WITH {INGESTED} SELECT * FROM ingested")
def ingest_chunks(spark, sf):
    """Gate, chunk, summarize, key, embed and describe every document."""
    rows = ingest.ingest(described(spark, sf), NOW, flags=flags(spark, sf), strategy="paragraph_clean",
                         options={"sep": NL}, summarizer=FIRST_SENTENCE)
    return shown(rows)


@query(f"""WITH {LINES}, {extractive_sql('lines', 'doc_id, chunk_id', 'chunk')}
SELECT doc_id || '_chunk_' || chunk_id AS vector_id, coalesce(e.summary, {LEAD.format('l.chunk')}) AS summary
FROM lines l LEFT JOIN extractive e USING (doc_id, chunk_id) WHERE n_chars >= 100""")
def ingest_extractive(spark, sf):
    """The flow with the built-in extractive engine over whole chunks."""
    rows = ingest.ingest(described(spark, sf), NOW, strategy="paragraph_clean", options={"sep": NL}, summarizer="extractive")
    return rows.select("vector_id", "summary")


RAW = f"""raw AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_id, ps[i] AS chunk FROM (
  SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents))),
first AS (SELECT *, {SQL_SENTENCES.format('chunk')} AS ss, CAST({SCORE.format('s')} AS DOUBLE) AS score
  FROM (SELECT *, array_to_string(({SQL_SENTENCES.format('chunk')})[1:1], ' ') AS s FROM raw)),
verdict AS (SELECT doc_id, CASE WHEN bool_or(score < 0.25) THEN 'resummarize' ELSE 'index' END AS decision FROM first GROUP BY doc_id)"""


@query(f"""WITH {RAW}, done AS (SELECT doc_id, chunk_id, decision,
  CASE WHEN decision = 'resummarize' THEN array_to_string(ss[1:4], ' ') ELSE s END AS summary FROM first JOIN verdict USING (doc_id))
SELECT doc_id, chunk_id, decision, summary, round(CAST({SCORE.format('summary')} AS DOUBLE), 6) AS score FROM done""")
def refine_summaries(spark, sf):
    """Documents with a weak first summary get longer summaries for all of their chunks."""
    rows = refine.refined(described(spark, sf), lambda c: T.lead(c, 1), lambda c: T.lead(c, 4), 0.25, sep=NL)
    return rows.select("doc_id", "chunk_id", "decision", "summary", F.round("score", 6).alias("score"))


@query(f"""WITH {LINES}, one AS (SELECT doc_id, chunk_id, chunk, {SQL_SENTENCES.format('chunk')}[1] AS s FROM lines),
verdict AS (SELECT doc_id, bool_or(CAST({SCORE.format('s')} AS DOUBLE) < 0.25) AS low FROM one GROUP BY doc_id),
done AS (SELECT doc_id, chunk_id, low, CASE WHEN low THEN upper(left(chunk, 1)) || ' ' || length(chunk) ELSE s END AS summary
         FROM one JOIN verdict USING (doc_id))
SELECT doc_id, chunk_id, summary, round(CAST({SCORE.format('summary')} AS DOUBLE), 6) AS score,
  CASE WHEN low THEN 'resummarize' ELSE 'index' END AS decision FROM done""")
def refine_by_models(spark, sf):
    """The same with batch functions in the place of models."""
    def first(chunks):
        return [re.split(r"(?<=[.!?]) +", c.strip())[0] for c in chunks]

    def second(chunks):
        return [f"{c[:1].upper()} {len(c)}" for c in chunks]

    rows = refine.refined_by_models(line_chunks(spark, sf), first, second, 0.25)
    return rows.select("doc_id", "chunk_id", "summary", F.round("score", 6).alias("score"), "decision")


@query(f"""WITH {LINES}, {VOTES} SELECT l.doc_id || '_chunk_' || l.chunk_id AS vector_id, l.version,
  round(CAST({SCORE.format(SUMMARY)} AS DOUBLE), 6) AS score, TRUE AS reindexed
FROM lines l JOIN votes v ON v.doc_id = l.doc_id AND NOT v.votes > 1.5""")
def gate_and_upload(spark, sf):
    """Judges without a length gate, then chunk, summarize, score and key every chunk."""
    rows = ingest.ingest(described(spark, sf), NOW, flags=flags(spark, sf), min_chars=None,
                         strategy="paragraph_clean", options={"sep": NL}, summarizer=FIRST_SENTENCE)
    return quality.scored(rows).select("vector_id", "version", F.round("score", 6).alias("score"),
                                       F.lit(True).alias("reindexed"))


def _reindexed(spark, sf, mode, full_first):
    """An older text of the labelled documents is indexed first, then everything as it is now."""
    docs = described(spark, sf).select("doc_id", "text", "version")
    older = docs.withColumn("text", F.concat(F.lit("old head\n"), "text", F.lit("\nold tail\nold end"))).withColumn(
        "version", F.lit("v_old"))
    labelled = table(spark, sf, "labels").select("doc_id")
    index_path, state_path = scratch_path(spark, "index"), scratch_path(spark, "state")
    settings = dict(strategy="paragraph_clean", sep=NL, summarizer=FIRST_SENTENCE, buckets=8)
    reindex.reindex(spark, older, index_path, state_path, NOW, ids=labelled, full=True, **settings)
    done = reindex.reindex(spark, docs, index_path, state_path, NOW + 1, mode=mode, full=full_first, **settings)
    return index_path, state_path, done


INDEX_ROWS = f"""WITH {LINES} SELECT doc_id || '_chunk_' || chunk_id AS vector_id, version, chunk FROM lines"""


@query(f"""WITH {LINES} SELECT doc_id || '_chunk_' || chunk_id AS vector_id, chunk FROM lines""")
def reindex_incremental(spark, sf):
    """Changed and missing chunks are indexed, chunks beyond the new end are dropped."""
    index_path, _, _ = _reindexed(spark, sf, "hash", False)
    return tables.Keyed(spark, index_path, buckets=8).read().select("vector_id", "chunk")


@query(INDEX_ROWS)
def reindex_full(spark, sf):
    index_path, _, _ = _reindexed(spark, sf, "hash", True)
    return tables.Keyed(spark, index_path, buckets=8).read().select("vector_id", "version", "chunk")


@query(f"""WITH {LINES} SELECT doc_id, any_value(version) AS version, CAST(count(*) AS BIGINT) AS chunks_indexed_count
FROM lines GROUP BY doc_id""")
def reindex_progress(spark, sf):
    """Progress reported by an incremental run."""
    return _reindexed(spark, sf, "hash", False)[2]


@query(f"""WITH {LINES}
SELECT doc_id, chunk_id, CASE WHEN cached THEN chunk ELSE summary END AS summary,
  CASE WHEN cached THEN 'cache' ELSE 'generated' END AS source FROM (
  SELECT l.*, {SUMMARY} AS summary, lang <> 'es' AND l.doc_id IN (SELECT doc_id FROM labels) AS cached FROM lines l)""")
def summarize_requests(spark, sf):
    """One request per document; labelled ones are cached, es requests opt out of the cache."""
    docs = described(spark, sf)
    cache = line_chunks(spark, sf, "acl", "ts").withColumnRenamed("chunk", "summary").join(
        table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    requests = docs.select("doc_id", (F.col("lang") != "es").alias("use_cache"))
    rows = ingest.summarize_requests(requests, docs, cache, NOW, strategy="paragraph_clean",
                                     options={"sep": NL}, summarizer=FIRST_SENTENCE)
    return rows.select("doc_id", "chunk_id", "summary", "source")
