"""Searches by stored indexes, bucketed tables and the evaluation log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import evaluation_log, phrase_index, quality, tag_index
from docmill.session import scratch_path, staged
from docmill.sources import bucketed
from docmill.workload.fixtures import LINES, SQL_TOKENS, documents, line_chunks, table
from docmill.workload.indexing import STATE, stored_state, versioned_lines
from docmill.workload.registry import query
from docmill.workload.scrutiny import SCORED, scored_lines
from docmill.workload.textual import KEYWORD_CTE

HAS = "doc_id IN (SELECT doc_id FROM kw_rank WHERE rk <= 10 AND w {0})"
ANY, NONE = ["with", "avec", "that"], ["the", "and"]
LISTED = [f"({', '.join(repr(t) for t in tags)})" for tags in (ANY, NONE)]


@query(f"""WITH {KEYWORD_CTE}
SELECT doc_id, 'any' AS kind FROM documents WHERE {HAS.format('IN ' + LISTED[0])}
UNION ALL SELECT doc_id, 'all' FROM documents WHERE {HAS.format("= 'with'")} AND {HAS.format("= 'that'")}
UNION ALL SELECT doc_id, 'none' FROM documents WHERE NOT {HAS.format('IN ' + LISTED[1])}
UNION ALL SELECT doc_id, 'mixed' FROM documents WHERE {HAS.format('IN ' + LISTED[0])} AND {HAS.format("= 'that'")}
  AND NOT {HAS.format('IN ' + LISTED[1])}""")
def tag_index_search(spark, sf):
    """Documents by their keywords, out of bitmaps: one of some tags, all of some, none of some, and all three at once."""
    tagged = documents(spark, sf).select("doc_id", T.top_keywords(F.col("text")).alias("keywords"))
    path = scratch_path(spark, "tags")
    tag_index.write_tag_index(tagged, path, partitions=16)
    asked = {"any": (ANY,), "all": (None, ["with", "that"]), "none": (None, None, NONE), "mixed": (ANY, ["that"], NONE)}
    found = [tag_index.with_tags(spark, path, *tags).withColumn("kind", F.lit(kind)) for kind, tags in asked.items()]
    return found[0].union(found[1]).union(found[2]).union(found[3])


ITEM_WORDS = f"asked AS (SELECT item_id AS qid, {SQL_TOKENS.format('text')} AS w FROM benchmark)"
DOC_WORDS = f"words AS (SELECT doc_id, {SQL_TOKENS.format('text')} AS w FROM documents)"


def _positions(spark, sf):
    path = scratch_path(spark, "positions")
    phrase_index.write_positions(documents(spark, sf), path, partitions=16)
    return path


def _asked(spark, sf, *places):
    words = T.tokens(F.col("text"))
    some = F.array_compact(F.array(*[F.get(words, F.lit(p)) for p in places]))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(some, " ").alias("text"))


@query(f"""WITH {ITEM_WORDS}, {DOC_WORDS},
place AS (SELECT doc_id, i, w[i + 1] AS a, w[i + 2] AS b FROM words, LATERAL (SELECT unnest(range(0, len(w) - 1)) AS i))
SELECT qid, doc_id, count(*) AS n_places, CAST(min(i) AS INTEGER) AS first
FROM place JOIN asked ON a = asked.w[1] AND b = asked.w[2] GROUP BY qid, doc_id""")
def phrase_index_search(spark, sf):
    """Where the first two words of each test item stand next to each other, out of positional postings."""
    return phrase_index.phrase_hits(spark, _positions(spark, sf), _asked(spark, sf, 0, 1))


WITHIN = 6


@query(f"""WITH {ITEM_WORDS}, {DOC_WORDS},
spot AS (SELECT doc_id, i, w[i + 1] AS word FROM words, LATERAL (SELECT unnest(range(0, len(w))) AS i)),
hit AS (
  SELECT qid, x.doc_id, least(x.i, y.i) AS first, abs(x.i - y.i) + 1 AS span
  FROM asked JOIN spot x ON x.word = asked.w[1] JOIN spot y ON y.doc_id = x.doc_id AND y.word = asked.w[3]
  WHERE abs(x.i - y.i) < {WITHIN})
SELECT qid, doc_id, CAST(span AS INTEGER) AS span, CAST(first AS INTEGER) AS first FROM hit
QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY span, first) = 1""")
def proximity_search(spark, sf):
    """Documents with the first and the third word of a test item within six words, in any order."""
    return phrase_index.proximity_hits(spark, _positions(spark, sf), _asked(spark, sf, 0, 2), WITHIN)


# ---- bucketed tables --------------------------------------------------------------------


def _bucketed(spark, rows, label, buckets=16):
    name = f"{label}_{uuid.uuid4().hex}"
    bucketed.write_bucketed(rows, name, scratch_path(spark, label), buckets)
    return name


@query(f"WITH {LINES} SELECT doc_id, chunk_id, chunk FROM lines WHERE doc_id IN (1, 23)")
def chunk_lookup_bucketed(spark, sf):
    """The chunks of two documents; Spark reads the buckets of their ids only."""
    name = _bucketed(spark, line_chunks(spark, sf).select("doc_id", "chunk_id", "chunk"), "chunks", 64)
    return bucketed.chunks_by_ids(spark, name, [1, 23])


@query(f"WITH {LINES}, {STATE} SELECT doc_id, chunk_id FROM lines EXCEPT SELECT doc_id, chunk_id FROM state")
def missing_chunks_bucketed(spark, sf):
    """Chunks and state bucketed alike: what is missing is found without an exchange."""
    chunks = _bucketed(spark, versioned_lines(spark, sf).select("doc_id", "chunk_id"), "chunks")
    state = _bucketed(spark, stored_state(spark, sf).select("doc_id", "chunk_id"), "state")
    return bucketed.missing_rows(spark.table(chunks), spark.table(state))


# ---- evaluation log ---------------------------------------------------------------------


@query(f"""WITH {LINES}, {SCORED}, runs AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run, * FROM scored)
SELECT run, CAST(count(*) AS BIGINT) AS chunks, round(avg(score), 6) AS mean_score,
  round(avg(CASE WHEN score < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS low_share, true AS median_close, true AS documents_close
FROM runs GROUP BY run""")
def evaluation_log_summary(spark, sf):
    """Two runs logged as sketches and read back; the sketches are held against exact values."""
    scored = staged(scored_lines(spark, sf).select("doc_id", "score", F.when(
        F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("run")), "scored")
    path = scratch_path(spark, "log")
    for run in ("even", "odd"):
        evaluation_log.append_run(scored.where(F.col("run") == run), path, run)
    error = evaluation_log.RANK_ERROR
    exact = scored.groupBy("run").agg(
        F.percentile("score", 0.5 - error).alias("low"), F.percentile("score", 0.5 + error).alias("high"),
        F.count_distinct("doc_id").alias("documents"))
    told = evaluation_log.summary(evaluation_log.runs(spark, path)).join(exact, "run")
    return told.select("run", "chunks", F.round("mean_score", 6).alias("mean_score"), F.round("low_share", 6).alias("low_share"),
                       F.col("q50").between(F.col("low"), F.col("high")).alias("median_close"),
                       (F.abs(F.col("n_documents") / F.col("documents") - 1) < 0.05).alias("documents_close"))
