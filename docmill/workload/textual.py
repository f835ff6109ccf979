"""Keywords, prompts, scores, summaries, vectors and record functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmill.functions import prompts, records, text as T, vectors
from docmill.workload.fixtures import (LINES, SQL_SENTENCES, SQL_TOKENS, ZERO_TIME, documents, line_chunks,
                                       table)
from docmill.workload.registry import query

FOUND_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{4,}'))"
# Word counts as SQL groups them: (doc_id, word, n, first).
KEYWORD_CTE = f"""kw_words AS (
  SELECT doc_id, w, i FROM (
    SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (
      SELECT doc_id, {FOUND_WORDS} AS ws FROM documents))),
kw_rank AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rk
  FROM (SELECT doc_id, w, count(*) AS n, min(i) AS first FROM kw_words GROUP BY doc_id, w)),
kw AS (
  SELECT d.doc_id, coalesce(string_agg(w, ', ' ORDER BY rk), '') AS keywords
  FROM documents d LEFT JOIN (SELECT * FROM kw_rank WHERE rk <= 10) k ON k.doc_id = d.doc_id
  GROUP BY d.doc_id)"""


@query(f"WITH {KEYWORD_CTE} SELECT doc_id, keywords FROM kw")
def keywords_top10(spark, sf):
    return documents(spark, sf).select("doc_id", T.joined_keywords(T.top_keywords(F.col("text"))).alias("keywords"))


@query(f"""WITH {KEYWORD_CTE},
answers AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN d.lang || ' , ' || d.source || ',, ' END AS answer
            FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN answer IS NULL THEN keywords ELSE array_to_string(list_filter(list_transform(
  string_split(answer, ','), lambda x: trim(x)), lambda x: x <> ''), ', ') END AS keywords
FROM answers JOIN kw USING (doc_id)""")
def keyword_mode(spark, sf):
    """Model answers where there are any (labelled documents), counted keywords elsewhere."""
    labelled = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("known"))
    docs = documents(spark, sf).join(labelled, "doc_id", "left").withColumn(
        "answer", F.when(F.col("known"), F.concat("lang", F.lit(" , "), "source", F.lit(",, "))))
    kw = T.keywords(F.col("text"), "llm", F.col("answer"))
    return docs.select("doc_id", T.joined_keywords(kw).alias("keywords"))


def _prompt_sql() -> str:
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def around(template: str, name: str, value: str) -> str:
        before, after = template.split("{" + name + "}")
        return f"{lit(before)} || {value} || {lit(after)}"
    nl = "chr(10) || chr(10)"
    rows = {
        "summarize": f"{lit(prompts.SUMMARIZE)} || {nl} || text",
        "judge": f"{lit(prompts.JUDGE)} || {nl} || text",
        "keywords": around(prompts.KEYWORDS.replace("{n}", "10"), "text", "text"),
        "evaluate": around(prompts.EVALUATE, "summary", "text"),
        "incident": around(prompts.INCIDENT, "incident_id", "CAST(doc_id AS VARCHAR)"),
    }
    return " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, CAST(length(p) AS INTEGER) AS size, md5(p) AS digest "
        f"FROM (SELECT doc_id, {v} AS p FROM documents)" for k, v in rows.items())


@query(_prompt_sql())
def prompt_rendering(spark, sf):
    c = F.col("text")
    kinds = {"summarize": prompts.summarize(c), "judge": prompts.judge(c), "keywords": prompts.keywords(c),
             "evaluate": prompts.evaluate(c), "incident": prompts.incident(F.col("doc_id"))}
    row = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("p")) for k, v in kinds.items()]))
    return documents(spark, sf).select("doc_id", row.alias("r")).select(
        "doc_id", "r.kind", F.length("r.p").alias("size"), F.md5("r.p").alias("digest"))


SCORE = """CASE WHEN length({0}) < 30 THEN 0.2 WHEN contains(lower({0}), 'lorem ipsum') THEN 0.1
  ELSE least(1.0, length({0}) / 300.0) END"""
LEAD = f"array_to_string(({SQL_SENTENCES})[1:3], ' ')"


@query(f"""SELECT doc_id, round(CAST({SCORE.format('summary')} AS DOUBLE), 6) AS score
FROM (SELECT doc_id, {LEAD.format('text')} AS summary FROM documents)""")
def summary_score(spark, sf):
    return documents(spark, sf).select("doc_id", F.round(records.summary_score(T.lead(F.col("text"))), 6).alias("score"))


@query(f"SELECT doc_id, {LEAD.format('text')} AS summary FROM documents")
def lead_summary(spark, sf):
    return documents(spark, sf).select("doc_id", T.lead(F.col("text")).alias("summary"))


def extractive_sql(source: str, keys: str, column: str) -> str:
    """extractive (keys, summary): the three sentences of a text with the most frequent words."""
    return f"""parts AS (SELECT {keys}, {SQL_SENTENCES.format(column)} AS ss FROM {source}),
sents AS (SELECT {keys}, unnest(ss) AS s, unnest(range(len(ss))) AS si FROM parts),
occ AS (SELECT {keys}, si, unnest({SQL_TOKENS.format('s')}) AS w FROM sents),
tf AS (SELECT {keys}, w, count(*) AS n FROM occ GROUP BY ALL),
sc AS (SELECT {keys}, si, sum(n) / count(*) AS score FROM occ JOIN tf USING ({keys}, w) GROUP BY {keys}, si),
best AS (SELECT {keys}, si FROM sc QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, si) <= 3),
extractive AS (SELECT {keys}, string_agg(s, ' ' ORDER BY si) AS summary FROM best JOIN sents USING ({keys}, si) GROUP BY {keys})"""


EXTRACTIVE = extractive_sql("documents", "doc_id", "text")


@query(f"""WITH {EXTRACTIVE}
SELECT d.doc_id, coalesce(e.summary, {LEAD.format('d.text')}) AS summary
FROM documents d LEFT JOIN extractive e USING (doc_id)""")
def extractive_summary(spark, sf):
    return documents(spark, sf).select("doc_id", T.extractive_batch(F.col("text")).alias("summary"))


BUCKETS = f"""tok AS (SELECT doc_id, unnest({SQL_TOKENS.format('text')}) AS w FROM documents),
bucket AS (SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS INTEGER) AS bucket,
                  CAST(count(*) AS INTEGER) AS n FROM tok GROUP BY ALL)"""


@query(f"WITH {BUCKETS} SELECT doc_id, bucket, n FROM bucket")
def hashed_counts(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.inline(vectors.hashed_counts(F.col("text"))))


@query(f"""WITH {BUCKETS}, norms AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM bucket GROUP BY doc_id),
cells AS (SELECT doc_id, CAST(b AS INTEGER) AS bucket FROM documents, range(64) t(b))
SELECT c.doc_id, c.bucket, round(coalesce(n / norm, 0.0), 6) AS value
FROM cells c LEFT JOIN bucket USING (doc_id, bucket) LEFT JOIN norms ON norms.doc_id = c.doc_id""")
def hashed_embedding(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.posexplode(vectors.hashed_embedding(F.col("text"))).alias("bucket", "value")).withColumn(
        "value", F.round("value", 6))


@query("""SELECT doc_id, k AS key, v AS value FROM (
  SELECT doc_id, 'lang' AS k, lang AS v FROM documents
  UNION ALL SELECT doc_id, 'source', CASE WHEN lang = 'en' THEN 'x' ELSE source END FROM documents
  UNION ALL SELECT doc_id, 'extra', CAST(n_chars AS VARCHAR) FROM documents WHERE lang = 'en')""")
def metadata_merge(spark, sf):
    base = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    override = F.when(F.col("lang") == "en", F.create_map(
        F.lit("source"), F.lit("x"), F.lit("extra"), F.col("n_chars").cast("string"))).otherwise(
        F.create_map().cast("map<string,string>"))
    return documents(spark, sf).select("doc_id", F.explode(records.merged_metadata(base, override)).alias("key", "value"))


@query("""SELECT doc_id, doc_id || '_chunk_' || length(source) AS vector_id, 'doc:' || doc_id AS cache_key,
  CAST(doc_id AS VARCHAR) AS cache_doc FROM documents""")
def ids_and_keys(spark, sf):
    key = records.cache_key(F.col("doc_id"))
    return documents(spark, sf).select(
        "doc_id", records.vector_id(F.col("doc_id"), F.length("source")).alias("vector_id"),
        key.alias("cache_key"), records.cache_doc(key).alias("cache_doc"))


def answer_column():
    """A model's JSON answer, good and bad forms by source."""
    n, reason = F.col("doc_id").cast("string"), F.col("lang")
    forms = {
        "src0": F.lit('{"reason": "none"}'), "src1": F.lit('{"score": null, "reason": "x"}'),
        "src2": F.lit('{"score": "7"}'), "src3": F.lit("[1, 2]"), "src4": F.lit("not json"),
        "src5": F.concat(F.lit('{"score": '), n, F.lit('} trailing')), "src6": F.lit(""),
        "src7": F.lit(None).cast("string"), "src8": F.lit('{"score": 4.5}'),
    }
    out = F.when(F.lit(False), "")
    for source, value in forms.items():
        out = out.when(F.col("source") == source, value)
    return out.otherwise(F.concat(F.lit('{"score": '), n, F.lit(', "reason": "'), reason, F.lit('"}')))


@query("""SELECT doc_id,
  CAST(CASE WHEN source = 'src9' THEN 0 WHEN source IN ('src0','src1','src2','src3','src4','src5','src6','src7') THEN 0
       WHEN source = 'src8' THEN 4.5 ELSE doc_id END AS DOUBLE) AS score,
  CASE WHEN source = 'src9' THEN 'Empty summary' WHEN source = 'src0' THEN 'none' WHEN source = 'src8' THEN ''
       WHEN source IN ('src1','src2','src3','src4','src5','src6','src7') THEN 'Evaluation error' ELSE lang END AS reason,
  CASE WHEN source IN ('src0','src1','src2','src3','src4','src5','src6','src7','src8','src9') THEN TRUE
       ELSE doc_id < 5 END AS needs_resummarize
FROM documents""")
def eval_parse(spark, sf):
    summary = F.when(F.col("source") == "src9", "").otherwise(F.col("text"))
    return documents(spark, sf).select(
        "doc_id", records.evaluation(summary, answer_column()).alias("e")).select("doc_id", "e.*")


@query(f"WITH {LINES} SELECT doc_id, chunk_id, chunk, coalesce(acl, 'none') AS acl FROM lines")
def json_round_trip(spark, sf):
    """Chunks through their JSON form and back."""
    chunks = line_chunks(spark, sf, "acl")
    schema = "doc_id long, chunk_id int, chunk string, acl string"
    packed = chunks.select(records.as_json("doc_id", "chunk_id", "chunk", "acl").alias("value"))
    return packed.select(records.from_json(F.col("value"), schema).alias("r")).select(
        "r.doc_id", "r.chunk_id", "r.chunk", F.coalesce("r.acl", F.lit("none")).alias("acl"))


@query("""SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch,
  CASE WHEN strftime(ts, '%f') = '000000' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
       ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso FROM events""")
def epoch_and_iso(spark, sf):
    since = F.col("ts").cast("timestamp_ntz") - F.lit(ZERO_TIME).cast("timestamp_ntz")
    seconds = F.floor(F.extract(F.lit("DAY"), since) * 86400 + F.extract(F.lit("HOUR"), since) * 3600
                      + F.extract(F.lit("MINUTE"), since) * 60 + F.extract(F.lit("SECOND"), since))
    return table(spark, sf, "events").select(
        "event_id", seconds.cast("bigint").alias("epoch"),
        records.iso_time(F.col("ts").cast("timestamp_ntz")).alias("iso"))

