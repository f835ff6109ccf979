"""Vector, keyword and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.functions import prompts, vectors
from docmill.operators import block_index, keyword_search, quality, vector_search
from docmill.operators.index import with_vector_id
from docmill.plans import answer
from docmill.session import scratch_path, staged
from docmill.sources import tables
from docmill.workload.fixtures import SQL_TOKENS, described, documents, table
from docmill.workload.filtering import QUESTIONS, questions
from docmill.workload.registry import query

VECTOR_ACL = "CASE WHEN label < 4 THEN 'public' WHEN label < 8 THEN 'team' END"


def shown(hits, column: str = "distance", digits: int = 6):
    """Costs are rounded only here, after they are ranked."""
    return hits.withColumn(column, F.round(column, digits))


def stored_vectors(spark, sf):
    return table(spark, sf, "embeddings").withColumn("acl", F.expr(VECTOR_ACL))


def label_means(spark, sf, name: str):
    """The mean vector of every label, rounded: used as query vectors and as list centroids."""
    means = quality.mean_vector(table(spark, sf, "embeddings"), "label", "mean")
    return means.select(F.col("label").alias(name), F.transform("mean", lambda x: F.round(x, 6)).alias("embedding"))


MEANS = """cells AS (SELECT label, i, avg(v::DOUBLE) AS m FROM (
    SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i),
means AS (SELECT label AS qid, list(round(m, 6) ORDER BY i) AS q FROM cells GROUP BY label)"""
DISTANCE = "list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - e[i]::DOUBLE) * (q[i] - e[i]::DOUBLE)))"


def nearest(k: int, where: str = "TRUE", name: str = "near") -> str:
    return f"""{name} AS (SELECT qid, vec_id, round(distance, 6) AS distance, acl, CAST(rk AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rk FROM (
    SELECT qid, vec_id, acl, {DISTANCE} AS distance FROM means, (
      SELECT vec_id, embedding AS e, {VECTOR_ACL} AS acl FROM embeddings) WHERE {where})) WHERE rk <= {k})"""


@query(f"WITH {MEANS}, {nearest(5)} SELECT qid, vec_id, distance, rank FROM near")
def vector_topk(spark, sf):
    return shown(vector_search.vector_top_k(stored_vectors(spark, sf), label_means(spark, sf, "qid"), 5))


@query(f"WITH {MEANS}, {nearest(5)} SELECT qid, vec_id, distance, rank FROM near WHERE acl = 'public'")
def vector_topk_acl_post(spark, sf):
    return shown(vector_search.vector_top_k(stored_vectors(spark, sf), label_means(spark, sf, "qid"), 5, acl="public"))


@query(f"""WITH {MEANS}, {nearest(5, "acl = 'public'")} SELECT qid, vec_id, distance, rank FROM near""")
def vector_topk_acl_pre(spark, sf):
    return shown(vector_search.vector_top_k(stored_vectors(spark, sf), label_means(spark, sf, "qid"), 5,
                                            acl="public", mode="pre"))


ASSIGNED = f"""assigned AS (SELECT vec_id, list_id, round(list_distance, 6) AS list_distance FROM (
  SELECT vec_id, qid AS list_id, {DISTANCE} AS list_distance FROM means, (SELECT vec_id, embedding AS e FROM embeddings))
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_distance, list_id) = 1)"""


@query(f"WITH {MEANS}, {ASSIGNED} SELECT vec_id, list_id, list_distance FROM assigned")
def ivf_assign(spark, sf):
    out = vector_search.assign_lists(stored_vectors(spark, sf), label_means(spark, sf, "list_id"))
    return shown(out.select("vec_id", "list_id", "list_distance"), "list_distance")


PROBED = f"""WITH {MEANS}, {ASSIGNED},
probes AS (SELECT qid, list_id FROM (SELECT a.qid, b.qid AS list_id,
    list_sum(list_transform(range(1, len(a.q) + 1), lambda i: (a.q[i] - b.q[i]) * (a.q[i] - b.q[i]))) AS d
  FROM means a, means b) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, list_id) <= 3)
SELECT qid, vec_id, round(distance, 6) AS distance, CAST(rk AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rk FROM (
    SELECT p.qid, a.vec_id, {DISTANCE} AS distance FROM probes p JOIN assigned a USING (list_id)
    JOIN means m ON m.qid = p.qid JOIN (SELECT vec_id, embedding AS e FROM embeddings) v ON v.vec_id = a.vec_id))
WHERE rk <= 5"""


@query(PROBED)
def ivf_search(spark, sf):
    """Search the three nearest of ten lists."""
    lists = label_means(spark, sf, "list_id")
    assigned = vector_search.assign_lists(stored_vectors(spark, sf), lists)
    return shown(vector_search.probe_top_k(assigned, lists, label_means(spark, sf, "qid"), 5, nprobe=3))


@query(PROBED)
def ivf_search_table(spark, sf):
    """The same over a table written by list; only the probed lists are read."""
    lists = label_means(spark, sf, "list_id")
    path = scratch_path(spark, "lists")
    tables.write_lists(vector_search.assign_lists(stored_vectors(spark, sf), lists), path)
    return shown(vector_search.probe_top_k(spark.read.parquet(path), lists, label_means(spark, sf, "qid"), 5, nprobe=3))


@query(f"""WITH hits AS (SELECT count(DISTINCT label) * 5 AS n FROM embeddings)
SELECT CAST(nprobe AS INTEGER) AS nprobe, n AS hits, TRUE AS grows, nprobe = 8 AS complete
FROM hits, (SELECT unnest([1, 2, 4, 8]) AS nprobe)""")
def ivf_train_recall(spark, sf):
    """Train eight lists and compare with the exact search, by lists probed: what is found grows up to everything."""
    rows, asked = stored_vectors(spark, sf), label_means(spark, sf, "qid")
    lists = vector_search.train_lists(rows, 8)
    assigned = staged(vector_search.assign_lists(rows, lists), "assigned")
    exact = staged(vector_search.vector_top_k(rows, asked, 5), "exact")
    out = None
    for nprobe in (1, 2, 4, 8):
        found = vector_search.probe_top_k(assigned, lists, asked, 5, nprobe=nprobe)
        one = vector_search.recall(found, exact).withColumn("nprobe", F.lit(nprobe))
        out = one if out is None else out.unionByName(one)
    before = F.lag("matched", 1, 1).over(Window.orderBy("nprobe"))  # four rows; something is found with one list
    return out.select("nprobe", "hits", (F.col("matched") >= before).alias("grows"),
                      (F.col("nprobe") == 8).alias("last"), (F.col("matched") == F.col("hits")).alias("all")).select(
        "nprobe", "hits", "grows", (F.col("last") & F.col("all")).alias("complete"))


@query("""SELECT least(1024, greatest(1, count(*) // 8), count(DISTINCT embedding)) AS lists,
  5 * count(*) FILTER (WHERE vec_id % 100 = 0) AS hits, TRUE AS complete, TRUE AS as_measured, TRUE AS enough
FROM embeddings WHERE embedding IS NOT NULL""")
def ivf_two_levels(spark, sf):
    """Lists trained in two levels, probed as often as a recall of 0.9 takes by the measure, which the search then meets."""
    rows = stored_vectors(spark, sf).where("embedding IS NOT NULL")
    asked = staged(rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding"), "asked")
    lists = vector_search.train_two_levels(rows, min(vector_search.NLIST_LARGE, max(1, rows.count() // 8)))
    assigned = staged(vector_search.assign_lists(rows, lists), "assigned")
    measured = staged(vector_search.recall_by_nprobe(assigned, lists, asked, 5), "measured")
    nprobe = vector_search.nprobe_for(measured)
    said, whole = measured.agg(F.max(F.when(F.col("nprobe") == nprobe, F.col("recall"))), F.max("recall")).first()
    found = vector_search.probe_top_k(assigned, lists, asked, 5, nprobe=nprobe)
    met = vector_search.recall(found, vector_search.vector_top_k(rows, asked, 5))
    return met.select(F.lit(lists.count()).cast("long").alias("lists"), "hits", F.lit(whole == 1).alias("complete"),
                      (F.col("recall") == said).alias("as_measured"), (F.col("recall") >= 0.9).alias("enough"))


COS = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"
COSINE = f"({COS} / (sqrt({COS.format('{0}', '{0}')}) * sqrt({COS.format('{1}', '{1}')})))"


def _mmr_sql(k: int = 5) -> str:
    ctes = [MEANS, nearest(20),
            f"""cand AS (SELECT n.qid, n.vec_id, n.rank, v.embedding AS e, {COSINE.format('m.q', 'v.embedding')} AS sim
  FROM near n JOIN means m USING (qid) JOIN embeddings v ON v.vec_id = n.vec_id)""",
            f"""pair AS (SELECT a.qid, a.rank AS ra, b.rank AS rb, {COSINE.format('a.e', 'b.e')} AS cos
  FROM cand a JOIN cand b USING (qid))""",
            """t1 AS (SELECT qid, rank, 0.5 * sim AS score, 1 AS step FROM cand
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY 0.5 * sim DESC, rank) = 1)"""]
    for s in range(2, k + 1):
        ctes.append(f"""t{s} AS (SELECT * FROM t{s - 1} UNION ALL SELECT qid, rank, score, {s} AS step FROM (
  SELECT c.qid, c.rank, 0.5 * any_value(c.sim) - 0.5 * max(p.cos) AS score
  FROM cand c JOIN t{s - 1} t ON t.qid = c.qid JOIN pair p ON p.qid = c.qid AND p.ra = c.rank AND p.rb = t.rank
  WHERE NOT EXISTS (SELECT 1 FROM t{s - 1} x WHERE x.qid = c.qid AND x.rank = c.rank)
  GROUP BY c.qid, c.rank) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) = 1)""")
    return (f"WITH {', '.join(ctes)} SELECT t.qid, c.vec_id, round(t.score, 6) AS score, CAST(t.step AS INTEGER) AS rank "
            f"FROM t{k} t JOIN cand c ON c.qid = t.qid AND c.rank = t.rank")


@query(_mmr_sql())
def mmr_topk(spark, sf):
    return shown(vector_search.mmr_top_k(stored_vectors(spark, sf), label_means(spark, sf, "qid")), "score")


TERMS = f"""toks AS (SELECT doc_id, {SQL_TOKENS.format('text')} AS ts FROM documents),
post AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS w FROM toks) GROUP BY doc_id, w),
dfs AS (SELECT w, count(*) AS df FROM post GROUP BY w)"""


def bm25_sql(k: int) -> str:
    return f"""{TERMS},
stats AS (SELECT count(*) AS n, sum(len(ts)) / count(*) AS mean FROM toks),
qterms AS (SELECT DISTINCT item_id AS qid, unnest({SQL_TOKENS.format('text')}) AS w FROM benchmark),
bm AS (SELECT qid, p.doc_id, sum(tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len(t.ts) / mean))
    * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ORDER BY w) AS score
  FROM qterms JOIN dfs USING (w) JOIN post p USING (w) JOIN toks t ON t.doc_id = p.doc_id, stats GROUP BY qid, p.doc_id),
bm25 AS (SELECT qid, doc_id, score, CAST(rk AS INTEGER) AS rank FROM (SELECT *,
  row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM bm) WHERE rk <= {k})"""


def bench_questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


WRITTEN: dict[tuple[str, str], str] = {}


def keyword_index(spark, sf) -> str:
    """The stored keyword index of the documents: written by the first query of a session that needs it."""
    key = spark.sparkContext.applicationId, sf
    if key not in WRITTEN:
        path = scratch_path(spark, "keywords")
        keyword_search.write_index(documents(spark, sf), path, partitions=16)
        WRITTEN[key] = path
    return WRITTEN[key]


@query(f"""WITH {TERMS} SELECT w AS term, df, CAST(tf AS BIGINT) AS tf, shortest
FROM dfs JOIN (SELECT w, sum(tf) AS tf, min(len(ts)) AS shortest FROM post JOIN toks USING (doc_id) GROUP BY w) USING (w)""")
def bm25_index(spark, sf):
    """Build the index, and read its tables back: document frequency, occurrences and shortest document per term."""
    path = scratch_path(spark, "keywords")
    keyword_search.write_index(documents(spark, sf), path, partitions=16)
    postings = spark.read.parquet(f"{path}/postings").groupBy("term").agg(
        F.sum("tf").alias("tf"), F.min("length").alias("shortest"))
    return keyword_search.terms_of(spark, path).join(postings, "term").select("term", "df", "tf", "shortest")


@query(f"WITH {bm25_sql(10)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM bm25")
def bm25_topk(spark, sf):
    """Every benchmark text as a query over every document."""
    return shown(keyword_search.bm25_top_k(spark, keyword_index(spark, sf), bench_questions(spark, sf), 10), "score")


def _block_index(spark, sf) -> str:
    path = scratch_path(spark, "blocks")
    block_index.write_index(documents(spark, sf), path, partitions=16)
    return path


@query(f"WITH {bm25_sql(10)} SELECT qid, doc_id, round(score, 6) AS score, rank FROM bm25")
def bm25_blocks(spark, sf):
    """The same hits from an index whose blocks are skipped where no hit can be."""
    return shown(block_index.bm25_top_k(spark, _block_index(spark, sf), bench_questions(spark, sf), 10), "score")


@query(f"""WITH {TERMS}, stats AS (SELECT count(*) AS n, sum(len(ts)) / count(*) AS mean FROM toks),
bm AS (SELECT w AS qid, p.doc_id, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len(t.ts) / mean))
    * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS score
  FROM dfs JOIN post p USING (w) JOIN toks t ON t.doc_id = p.doc_id, stats WHERE 10 * df >= n)
SELECT qid, doc_id, round(score, 6) AS score, CAST(rk AS INTEGER) AS rank FROM (SELECT *,
  row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM bm) WHERE rk <= 10""")
def bm25_common_terms(spark, sf):
    """The best documents of every term that a tenth of the documents hold: few blocks of such a term matter."""
    path = _block_index(spark, sf)
    terms = keyword_search.stored_terms(spark, path)
    n = terms.where(F.col("term") == keyword_search.EVERY).select(F.col("df").alias("n"))
    common = terms.where(F.col("term") != keyword_search.EVERY).join(F.broadcast(n), F.col("df") * 10 >= F.col("n"))
    asked = common.select(F.col("term").alias("qid"), F.col("term").alias("text"))
    return shown(block_index.bm25_top_k(spark, path, asked, 10), "score")


def embedded_sql(name: str, source: str, key: str) -> str:
    """Hashed bag-of-words vectors as lists of 64."""
    return f"""{name}_tok AS (SELECT {key} AS id, unnest({SQL_TOKENS.format('text')}) AS w FROM {source}),
{name}_bucket AS (SELECT id, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS INTEGER) AS b, count(*) AS n
  FROM {name}_tok GROUP BY ALL),
{name}_norm AS (SELECT id, sqrt(sum(n * n)) AS norm FROM {name}_bucket GROUP BY id),
{name} AS (SELECT c.id, list(coalesce(n / norm, 0.0) ORDER BY c.b) AS v
  FROM (SELECT {key} AS id, b FROM {source}, range(64) t(b)) c
  LEFT JOIN {name}_bucket k ON k.id = c.id AND k.b = c.b LEFT JOIN {name}_norm m ON m.id = c.id GROUP BY c.id)"""


TEXT_DISTANCE = "list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - d.v[i]) * (q.v[i] - d.v[i])))"
TEXT_NEAR = f"""{embedded_sql('dv', 'documents', 'doc_id')}, {embedded_sql('qv', 'benchmark', 'item_id')},
near AS (SELECT qid, doc_id, distance, rk AS rank FROM (SELECT *,
  row_number() OVER (PARTITION BY qid ORDER BY distance, doc_id) AS rk FROM (
    SELECT q.id AS qid, d.id AS doc_id, {TEXT_DISTANCE} AS distance FROM qv q, dv d)) WHERE rk <= 10)"""


@query(f"""WITH {TEXT_NEAR}, {bm25_sql(10)}
SELECT qid, doc_id, round(score, 9) AS score, CAST(rk AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM (
    SELECT coalesce(n.qid, b.qid) AS qid, coalesce(n.doc_id, b.doc_id) AS doc_id,
           coalesce(1.0::DOUBLE / (60 + n.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score
    FROM near n FULL JOIN bm25 b ON b.qid = n.qid AND b.doc_id = n.doc_id)) WHERE rk <= 10""")
def hybrid_rrf(spark, sf):
    out = answer.hybrid(documents(spark, sf), bench_questions(spark, sf), keyword_index(spark, sf), 10)
    return shown(out.select("qid", "doc_id", "score", "rank"), "score", 9)


def prompt_sql(hits: str) -> str:
    """Prompts over `hits` (qid, rank, passage), with every question of the benchmark."""
    assistant = prompts.ASSISTANT.replace("'", "''")
    return f"""ctx AS (SELECT qid, count(*) AS n, string_agg(passage, chr(10) || chr(10) ORDER BY rank) AS context
        FROM {hits} GROUP BY qid)
SELECT item_id AS qid, CAST(coalesce(n, 0) AS INTEGER) AS passages, md5('{assistant}'
  || chr(10) || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || text) AS digest
FROM benchmark LEFT JOIN ctx ON item_id = qid"""


@query(f"""WITH {bm25_sql(3)}, hits AS (SELECT qid, rank, d.text AS passage FROM bm25 JOIN documents d USING (doc_id)),
{prompt_sql('hits')}""")
def rag_context(spark, sf):
    """Questions with the whole texts of their three best documents."""
    asked = bench_questions(spark, sf)
    hits = keyword_search.bm25_top_k(spark, keyword_index(spark, sf), asked, 3)
    out = answer.prompts_for(asked, hits, documents(spark, sf), ["doc_id"], "text")
    return out.select("qid", "passages", F.md5("prompt").alias("digest"))


def _rag_mmr_sql() -> str:
    """The five most relevant and diverse vectors of a label's mean, their documents as passages of question number label."""
    return _mmr_sql().replace(" SELECT t.qid, c.vec_id", ", picked AS (SELECT t.qid, c.vec_id") + f"""),
hits AS (SELECT qid, rank, d.text AS passage FROM picked JOIN documents d ON d.doc_id = vec_id),
{prompt_sql('hits')}"""


@query(_rag_mmr_sql())
def rag_mmr(spark, sf):
    """Diverse hits into prompts: a vector stands for the document of the same number."""
    hits = vector_search.mmr_top_k(stored_vectors(spark, sf), label_means(spark, sf, "qid"))
    texts = documents(spark, sf).withColumnRenamed("doc_id", "vec_id")
    out = answer.prompts_for(bench_questions(spark, sf), hits, texts, ["vec_id"], "text")
    return out.select("qid", "passages", F.md5("prompt").alias("digest"))


def dispatch_sql(top_k: int | None, top_p: float | None, rank: str) -> str:
    near = f"QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, doc_id || '_chunk_0') <= {top_k}" if top_k else ""
    share = f"rk <= greatest(floor(n * {top_p}), 1)" if top_p else "TRUE"
    return f"""WITH {QUESTIONS}, {embedded_sql('dv', 'documents', 'doc_id')}, {embedded_sql('qv', 'benchmark', 'item_id')},
dl AS (SELECT doc_id, text AS summary, CASE WHEN lang = 'en' THEN 'public' WHEN lang IN ('fr', 'de') THEN 'team' END AS acl,
  CASE WHEN source <> 'src7' THEN 1704067200 + doc_id * 60 END AS ts FROM documents),
vhit AS (SELECT n.qid, n.doc_id, row_number() OVER (PARTITION BY n.qid ORDER BY distance, n.doc_id || '_chunk_0') AS rk,
    count(*) OVER (PARTITION BY n.qid) AS n
  FROM (SELECT * FROM (SELECT q.id AS qid, d.id AS doc_id, {TEXT_DISTANCE} AS distance FROM qv q, dv d
                       WHERE q.id IN (SELECT item_id FROM benchmark WHERE length(text) > 170)) {near}) n
  JOIN asked a ON a.qid = n.qid JOIN dl ON dl.doc_id = n.doc_id AND (a.acl IS NULL OR a.acl = dl.acl)),
khit AS (SELECT a.qid, dl.doc_id, row_number() OVER (PARTITION BY a.qid ORDER BY dl.doc_id) AS rk,
    count(*) OVER (PARTITION BY a.qid) AS n
  FROM asked a JOIN benchmark b ON b.item_id = a.qid AND length(b.text) <= 170 AND keyword <> ''
  JOIN dl ON contains(lower(summary), lower(keyword)) AND (a.acl IS NULL OR a.acl = dl.acl)
   AND (min_time = 0 OR coalesce(ts, 0) >= min_time) AND (max_time IS NULL OR coalesce(ts, 0) <= max_time))
SELECT qid, doc_id || '_chunk_0' AS vector_id, {rank} AS rank, branch
FROM (SELECT *, 'vector' AS branch FROM vhit UNION ALL SELECT *, 'keyword' AS branch FROM khit)
WHERE {share} AND {f'rk <= {top_k}' if top_k else 'TRUE'}"""


def _dispatched(spark, sf, top_k, top_p):
    """Longer requests carry a vector, shorter ones a keyword; a document is one chunk with its whole text."""
    chunks = with_vector_id(described(spark, sf).select(
        "doc_id", F.lit(0).alias("chunk_id"), F.col("text").alias("summary"), "acl", "ts",
        vectors.hashed_embedding(F.col("text")).alias("embedding")))
    asked = questions(spark, sf).withColumn("embedding", F.when(
        F.length("text") > 170, vectors.hashed_embedding(F.col("text"))))
    return answer.dispatch(chunks, asked, top_k, top_p)


@query(dispatch_sql(10, 0.5, "CAST(rk AS INTEGER)"))
def query_dispatch(spark, sf):
    """Half of the hits, ten at most."""
    return _dispatched(spark, sf, 10, 0.5)


@query(dispatch_sql(None, None, "rk"))
def query_dispatch_unlimited(spark, sf):
    """All hits of every request: 0 and None mean no limit."""
    return _dispatched(spark, sf, 0, None)
