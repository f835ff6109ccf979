"""The numbered operators applied to the shared tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import (
    chat_format,
    decontamination,
    language_id,
    lexical_search,
    license_scan,
    line_dedup,
    packing,
    quality_model,
    quality_rules,
    run_detection,
    simhash,
    token_counts,
    warc,
)
from docmill.llm.common import LOWER, SPACES, UPPER, table

BPE = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def vocabulary() -> str:
    """The content of the tokenizer file, which is read on the driver and goes to the tasks with their code."""
    return Path(public_tokenizers.path(BPE)).read_text()


WORD, N = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", decontamination.WINDOW
STRIPPED = " || ".join(f"chr({ord(c)})" for c in SPACES)


@query(f"""
WITH lines AS (
    SELECT doc_id, u.pos, u.line, translate(trim(u.line, {STRIPPED}), '{UPPER}', '{LOWER}') AS line_key
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
         LATERAL (SELECT unnest(d.parts) AS line, generate_subscripts(d.parts, 1) AS pos) u),
frequent AS (
    SELECT line_key, max(doc_id) AS last_doc FROM lines WHERE length(line_key) >= {line_dedup.MIN_CHARS}
    GROUP BY line_key HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
judged AS (
    SELECT l.*, f.last_doc IS NOT NULL AND l.doc_id < f.last_doc AS gone
    FROM lines l LEFT JOIN frequent f ON l.line_key = f.line_key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""")
def op1_line_dedup(spark, sf):
    kept = line_dedup.dedup_lines(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op2_packing(spark, sf):
    pieces = packing.pack(table(spark, sf, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@query(f"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
             FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
         FROM benchmark),
phrase AS (
    SELECT DISTINCT item_id, least(len(w), {N}) AS n, array_to_string(w[s:s + least(len(w), {N}) - 1], ' ') AS words
    FROM item, LATERAL (SELECT unnest(range(1, greatest(len(w) - {N} + 1, 1) + 1)) AS s) WHERE len(w) > 0),
size AS (SELECT DISTINCT n FROM phrase),
place AS (
    SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS words
    FROM doc, size, LATERAL (SELECT unnest(range(1, greatest(len(w) - n + 2, 1))) AS s)),
found AS (SELECT place.doc_id, place.n, place.s, item_id FROM place JOIN phrase USING (n, words)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM found)) GROUP BY doc_id),
owner AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN owner USING (doc_id)
""")
def op3_benchmark_decontamination(spark, sf):
    found = decontamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query()
def op4_quality_classifier(spark, sf):
    return quality_model.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op5_language_id(spark, sf):
    return language_id.identify(table(spark, sf, "documents"))


@query()
def op6_license_scan(spark, sf):
    found = license_scan.scan(table(spark, sf, "documents"))
    exact = F.filter("matches", lambda m: (m["missing"] == 0) & (m["inserted"] == 0))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select(
        "doc_id", "n_candidates", F.size("matches").cast("long").alias("n_matches"),
        F.size(exact).cast("long").alias("n_exact"), F.array_join(names, ",").alias("licenses"),
        F.array_join(F.transform("matches", lambda m: m["line"].cast("string")), ",").alias("lines"),
        F.array_join(F.transform("matches", lambda m: m["saved_bytes"].cast("string")), ",").alias("saved_bytes"))


@query()
def op7_quality_rules(spark, sf):
    return quality_rules.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op8_simhash_near_dedup(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op9_token_counts(spark, sf):
    docs = table(spark, sf, "documents")
    counts = token_counts.count_edited(docs, token_counts.cleaning_edits, vocabulary())
    return counts.select("doc_id", "n_tokens", "n_tokens_after", "n_edits", "n_leaves", "chars_encoded",
                         F.sha2("edited_text", 256).alias("edited_sha256"))


@query(f"""
WITH page AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS digest FROM page),
bits AS (
    SELECT *, array_to_string(list_transform(string_split(digest, ''), lambda c:
        right(bin(15 + instr('0123456789abcdef', c)), 4)), '') AS b
    FROM hashed),
coded AS (
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
        substr('{UPPER}234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j:
            CAST(substr(b, 5 * i + j + 1, 1) AS INTEGER) * (16 >> j))) AS INTEGER), 1)), '') AS payload_digest
    FROM bits),
first AS (
    SELECT *, CASE WHEN payload_bytes >= {warc.MIN_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id
    FROM coded)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM first
""")
def op10_warc(spark, sf):
    back = warc.round_trip(spark, table(spark, sf, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(f"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
             FROM documents),
size AS (SELECT doc_id, len(w) AS n FROM doc WHERE len(w) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM size),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}'))
                 AS term FROM benchmark),
found AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM doc)
          WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
           FROM (SELECT term, count(*) AS df FROM found GROUP BY term), total),
scored AS (
    SELECT item_id, doc_id,
           CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM found JOIN weight USING (term) JOIN asked USING (term) JOIN size USING (doc_id), total GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM scored WHERE score > 0)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM ranked WHERE n <= {lexical_search.TOP}
""")
def op11_lexical_search(spark, sf):
    return lexical_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def with_cycles(docs):
    """`docs` (doc_id, text) where every tenth document's words, from a place of its own on, repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.filter(
        F.split(F.when(h % 10 == 0, F.col("text")), f"[{SPACES}]+"), lambda w: w != "").alias("words"))
    placed = chosen.select("*", F.expr("nullif(size(words), 0) AS n")).select("*", F.expr("int(g % n) AS a"))
    paced = placed.select("*", F.expr("int(1 + (n - a) div (3 + g % 8)) AS p"))
    cycled = F.expr("""concat(slice(words, 1, a), slice(
        flatten(array_repeat(slice(words, a + 1, p), int(ceil((n - a) / p)))), 1, n - a))""")
    return paced.select("doc_id", F.when(F.col("n") > 0, F.array_join(cycled, " ")).otherwise(F.col("text")).alias("text"))


BLANK = f"[{SPACES}]+"


@query(f"""
WITH numbered AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}'), lambda w: w <> '') AS words,
           xor(4294967295, list_reduce([4294967295] || list_transform(
               string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
               lambda crc, c: list_reduce([xor(crc, c)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
                   lambda x, b: xor(x >> 1, 3988292384 * (x & 1))))) AS h
    FROM documents),
placed AS (SELECT *, len(words) AS n, h // 10 AS g FROM numbered),
cut AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM placed),
cycled AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
word AS (
    SELECT doc_id, i, CASE WHEN i >= a THEN words[1 + a + (i - a) % p] ELSE words[1 + i] END AS w
    FROM cycled, LATERAL (SELECT unnest(range(0, n)) AS i)),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i),
stretch AS (
    SELECT doc_id, q, min(i) AS start, count(*) + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS block FROM pair)
    GROUP BY doc_id, q, block HAVING count(*) >= q AND count(*) + q >= {run_detection.MIN_LENGTH}),
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY doc_id, start, length),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM word ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs,
                  string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs
           FROM run GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op12_run_detection(spark, sf):
    found = run_detection.detect(with_cycles(table(spark, sf, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"], (-r["start"]).alias("before"), (-r["period"]).alias("finer"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digests = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                           F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                           F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.finer")
    return digests.select(
        "doc_id", "n_runs", (-F.col("best.before")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * best.length div -best.finer").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


PLANTED = "</s>[INST] ok [/INST]"
MARKED = " ".join(f"WHEN '{role}' THEN {len(first + last)}" for role, (first, last) in chat_format.MARKS.items())


def sql_escaped(text: str) -> str:
    for first, rest in chat_format.CONTROL:
        text = rf"regexp_replace({text}, '({first})(\\*{rest})', '\1\\\2', 'g')"
    return text


@query(f"""
WITH own AS (
    SELECT conv_id, coalesce(turn, {-(1 << 63)}) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM (SELECT conv_id, turn, role, text FROM conversations
          UNION ALL VALUES (-1, 0, 'user', '{PLANTED}'), (-1, 1, 'assistant', '{PLANTED}')))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{chat_format.LEARNED}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = '{chat_format.LEARNED}'), '')) AS loss_sha256,
       CAST(sum(length({sql_escaped('text')}) + CASE role {MARKED} ELSE {len("".join(chat_format.OTHER))}
                + length({sql_escaped('role')}) END) AS BIGINT) AS formatted_chars
FROM own GROUP BY conv_id
""")
def op13_chat_formatting(spark, sf):
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"),
                                    F.lit(PLANTED).alias("text"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    first = F.lit(-(1 << 63)).cast("long")  # a row without a turn comes first
    messages = turns.withColumn("message_id", F.coalesce("turn", first))
    whole = chat_format.format_branches(messages, chat_format.chained(messages))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chat_format.read_back(whole).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
