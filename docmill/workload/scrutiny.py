"""Gate, votes, scores, decisions, model calls and their reports."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from docmill.functions import prompts, text as T
from docmill.operators import inference, quality
from docmill.session import small_batches, staged
from docmill.workload.fixtures import LINES, SQL_SENTENCES, documents, line_chunks, table
from docmill.workload.registry import query
from docmill.workload.textual import SCORE

LABEL_JUDGE = "toxic = 1"
JUDGES = "contains(lower(text), 'error')", "n_chars < 200"
VOTES = """votes AS (SELECT d.doc_id, d.text, d.n_chars,
  CAST(coalesce(toxic = 1, FALSE) AS INTEGER) + CAST(contains(lower(text), 'error') AS INTEGER)
  + CAST(n_chars < 200 AS INTEGER) AS votes FROM documents d LEFT JOIN labels USING (doc_id))"""


def judge_columns(spark, sf):
    """(doc_id, n_chars, one vote per judge). The text judges run before the join with the labels,
    so no text is shuffled."""
    own = documents(spark, sf).select("doc_id", "n_chars", *[F.expr(j).alias(f"j{i}") for i, j in enumerate(JUDGES, 1)])
    known = table(spark, sf, "labels").select("doc_id", F.expr(LABEL_JUDGE).alias("j0"))
    return own.join(known, "doc_id", "left")


VOTE_COLUMNS = ["j0", "j1", "j2"]


def flags(spark, sf):
    """(doc_id, flagged) by majority, for flows that take external judges."""
    flagged = quality.flagged_by([F.col(c) for c in VOTE_COLUMNS])
    return judge_columns(spark, sf).select("doc_id", flagged.alias("flagged"))


@query(f"""WITH {VOTES} SELECT doc_id, CAST(votes AS BIGINT) AS votes, CAST(3 AS BIGINT) AS checks,
  votes > 1.5 AS flagged FROM votes""")
def scrutiny_vote(spark, sf):
    rows = quality.judge_rows(judge_columns(spark, sf), {c: F.col(c) for c in VOTE_COLUMNS})
    return quality.majority(rows)


@query(f"WITH {VOTES} SELECT doc_id, n_chars >= 100 AND NOT votes > 1.5 AS passes FROM votes")
def document_gate(spark, sf):
    flagged = quality.flagged_by([F.col(c) for c in VOTE_COLUMNS])
    ok = quality.passes(flagged, F.col("n_chars"))
    return judge_columns(spark, sf).select("doc_id", ok.alias("passes"))


SCORED = f"""scored AS (SELECT doc_id, chunk_id, CAST({SCORE.format('summary')} AS DOUBLE) AS score FROM (
  SELECT doc_id, chunk_id, {SQL_SENTENCES.format('chunk')}[1] AS summary FROM lines))"""


def scored_lines(spark, sf):
    """First sentence of every line as its summary, scored."""
    rows = line_chunks(spark, sf).withColumn("summary", T.lead(F.col("chunk"), 1))
    return quality.scored(rows)


@query(f"""WITH {LINES}, {SCORED} SELECT d.doc_id, CAST(count(score) AS BIGINT) AS scores,
  CASE WHEN count(score) = 0 OR bool_or(score < 0.25) THEN 'resummarize' ELSE 'index' END AS decision
FROM documents d LEFT JOIN scored s USING (doc_id) GROUP BY d.doc_id""")
def resummarize_decision(spark, sf):
    return quality.decide(scored_lines(spark, sf), documents(spark, sf), 0.25)


@query(f"""WITH {LINES}, {SCORED} SELECT doc_id, CAST(count(*) AS BIGINT) AS chunks, round(avg(score), 6) AS mean_score,
  round(min(score), 6) AS min_score, round(avg(CASE WHEN score < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS low_share
FROM scored GROUP BY doc_id""")
def eval_report(spark, sf):
    return quality.evaluation_report(scored_lines(spark, sf))


@query("""WITH cells AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings),
half AS (SELECT avg(vec_id) AS m FROM embeddings),
means AS (SELECT label, i, avg(v) FILTER (vec_id < m) AS a, avg(v) FILTER (vec_id >= m) AS b FROM cells, half GROUP BY label, i)
SELECT label, round(sqrt(sum((a - b) * (a - b))), 6) AS drift FROM means GROUP BY label""")
def embedding_drift(spark, sf):
    """Older half against newer half of the vectors, per label."""
    rows = table(spark, sf, "embeddings")
    middle = rows.agg(F.avg("vec_id")).scalar()
    return quality.embedding_drift(rows.where(F.col("vec_id") < middle), rows.where(F.col("vec_id") >= middle), "label")


def grade(asked: list[str]) -> list[str]:
    """Stands in for a grading model: the score is the number of commas, prompts with a digit in the summary are refused."""
    around = prompts.EVALUATE.split("{summary}")
    return ["refused" if re.search("[0-9]", p[len(around[0]):-len(around[1])])
            else json.dumps({"score": p.count(","), "reason": f"{p.count('.')} stops"}) for p in asked]


def _grade_sql() -> str:
    around = prompts.EVALUATE.replace("{summary}", "")
    c, d = around.count(","), around.count(".")
    commas = f"(length(text) - length(replace(text, ',', '')) + {c})"
    stops = f"(length(text) - length(replace(text, '.', '')) + {d})"
    ok = "NOT regexp_matches(text, '[0-9]')"
    return f"""SELECT doc_id, CAST(CASE WHEN {ok} THEN {commas} ELSE 0 END AS DOUBLE) AS score,
  CASE WHEN {ok} THEN {stops} || ' stops' ELSE 'Evaluation error' END AS reason,
  CASE WHEN {ok} THEN {commas} < 5 ELSE TRUE END AS needs_resummarize FROM documents"""


@query(_grade_sql())
def batch_evaluation(spark, sf):
    """Prompt, model answer and parse for every document."""
    rows = documents(spark, sf).select("doc_id", F.col("text").alias("summary"))
    return inference.evaluated(rows, grade).select("doc_id", "evaluation.*")


def strict(asked: list[str]) -> list[str]:
    return ["Yes." if "error" in p.lower() else "No" for p in asked]


def lenient(asked: list[str]) -> list[str]:
    return ["yes, clearly" if "(" in p else "no" for p in asked]


def broken(asked: list[str]) -> list[str]:
    raise RuntimeError("judge is down")


@query("""SELECT doc_id, CAST(a + b AS BIGINT) AS votes, CAST(3 AS BIGINT) AS checks, a + b > 1.5 AS flagged FROM (
  SELECT doc_id, CAST(contains(lower(text), 'error') AS INTEGER) AS a,
         CAST(contains(text, '(') AS INTEGER) AS b FROM documents)""")
def model_judges(spark, sf):
    """Three model judges over whole texts; the one that fails never flags."""
    votes = inference.judged(documents(spark, sf), {"strict": strict, "lenient": lenient, "broken": broken})
    with small_batches(spark):
        return quality.majority(staged(votes, "votes"))


def word_count_summary(chunks: list[str]) -> list[str]:
    """Stands in for a summarizer: fails on chunks with a digit."""
    out = []
    for c in chunks:
        if any(ch in "0123456789" for ch in c):
            raise ValueError("digits")
        out.append(f"{len(c)} characters")
    return out


@query(rf"""WITH {LINES} SELECT doc_id, chunk_id, CASE WHEN regexp_matches(chunk, '[0-9]') THEN ''
  ELSE length(chunk) || ' characters' END AS summary FROM lines""")
def batch_summary(spark, sf):
    """A supplied engine over every chunk; a failing chunk has an empty summary."""
    rows = line_chunks(spark, sf)
    return inference.summarize(rows, "seq2seq", {"seq2seq": word_count_summary}).drop("chunk")


@query(rf"""WITH {LINES} SELECT doc_id, chunk_id, CASE WHEN regexp_matches(chunk, '[0-9]') THEN 'failed' ELSE 'ok' END AS status,
  CAST(CASE WHEN regexp_matches(chunk, '[0-9]') THEN 2 ELSE 1 END AS INTEGER) AS attempts FROM lines""")
def retry_failed(spark, sf):
    """Status and attempts when failed rows are tried once more."""
    out = inference.infer(line_chunks(spark, sf), "chunk", word_count_summary, retry=True)
    return out.select("doc_id", "chunk_id", F.col("answer_status").alias("status"),
                      F.col("answer_attempts").alias("attempts"))


@query(rf"""WITH {LINES} SELECT doc_id, CASE WHEN bool_or(regexp_matches(chunk, '[0-9]')) THEN 'failed' ELSE 'ok' END AS status
FROM lines GROUP BY doc_id""")
def failed_documents(spark, sf):
    """A document failed when one of its chunks did, after the retry."""
    out = inference.infer(line_chunks(spark, sf), "chunk", word_count_summary, retry=True)
    with small_batches(spark):
        out = staged(out.select("doc_id", "answer_status"), "answers")
    return out.groupBy("doc_id").agg(F.max(F.when(F.col("answer_status") == "failed", 1).otherwise(0)).alias("f")).select(
        "doc_id", F.when(F.col("f") == 1, "failed").otherwise("ok").alias("status"))
