"""Ids, metadata, scores and answers of a chunk, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DEFAULT_ACL = "public"
DEFAULT_COLLECTION = "default_collection"
SHORT_SUMMARY = 30
SHORT_SCORE = 0.2
FILLER = "lorem ipsum"
FILLER_SCORE = 0.1
FULL_SCORE_CHARS = 300
PASS_MARK = 5
EMPTY_SUMMARY = "Empty summary"
EVALUATION_ERROR = "Evaluation error"


def vector_id(doc_id: Column, chunk_id: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit("_chunk_"), chunk_id.cast("string"))


def chunk_prefix(doc_id: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit("_chunk_"))


def cache_key(doc_id: Column) -> Column:
    return F.concat(F.lit("doc:"), doc_id.cast("string"))


def cache_doc(key: Column) -> Column:
    """The text between the first and second colon of a cache key."""
    return F.get(F.split(key, ":", -1), F.lit(1))


def merged_metadata(base: Column, override: Column) -> Column:
    """Union of two maps; `override` wins. A missing side counts as empty, two give null."""
    none = F.map_filter(F.coalesce(base, override), lambda k, v: F.lit(False))
    mine, theirs = F.coalesce(base, none), F.coalesce(override, none)
    return F.map_concat(F.map_filter(mine, lambda k, v: ~F.map_contains_key(theirs, k)), theirs)


def as_json(*columns: str) -> Column:
    """The named columns as one JSON object; nulls are left out."""
    return F.to_json(F.struct(*columns))


def from_json(value: Column, schema: str) -> Column:
    """The object of `as_json` as a struct; missing fields are null, text that is no object gives null fields."""
    return F.from_json(value, schema)


def summary_score(summary: Column) -> Column:
    """0..1 heuristic: too short, filler text, else growing with length."""
    size = F.length(F.coalesce(summary, F.lit("")))
    return (
        F.when(size < SHORT_SUMMARY, F.lit(SHORT_SCORE))
        .when(F.contains(F.lower(summary), F.lit(FILLER)), F.lit(FILLER_SCORE))
        .otherwise(F.least(F.lit(1.0), size / F.lit(float(FULL_SCORE_CHARS))))
    )


def is_yes(answer: Column) -> Column:
    """Judge answer: flagged when it says yes; no answer is not flagged."""
    return F.coalesce(F.contains(F.lower(answer), F.lit("yes")), F.lit(False))


def evaluation(summary: Column, answer: Column) -> Column:
    """JSON answer -> (score, reason, needs_resummarize).

    An answer counts only when it is one JSON object and nothing else. A missing score is
    0; a null or text score is an error, like an answer that does not parse.
    """
    def result(score: Column, reason: Column, needs: Column) -> Column:
        return F.struct(score.cast("double").alias("score"), reason.cast("string").alias("reason"),
                        needs.alias("needs_resummarize"))

    # Inside a one-element list the parser also refuses text after the object.
    parsed = F.try_parse_json(F.concat(F.lit("["), answer, F.lit("]")))
    kind = F.schema_of_variant(parsed)
    score_kind = F.schema_of_variant(F.try_variant_get(parsed, "$[0].score", "variant"))
    is_object = kind.startswith("ARRAY<OBJECT<") & F.try_variant_get(parsed, "$[1]", "variant").isNull()
    closed = F.rtrim(F.regexp_replace(answer, r"[\t\r\n]", " ")).endswith("}")
    score = F.coalesce(F.try_variant_get(parsed, "$[0].score", "double"), F.lit(0.0))
    has_number = score_kind.isNull() | ~score_kind.rlike("^(VOID|STRING|ARRAY|OBJECT)")
    reason = F.when(F.try_variant_get(parsed, "$[0].reason", "variant").isNull(), F.lit("")).otherwise(
        F.try_variant_get(parsed, "$[0].reason", "string"))
    usable = F.coalesce(is_object & closed & has_number, F.lit(False))
    return (
        F.when(F.coalesce(summary, F.lit("")) == "",
               result(F.lit(0), F.lit(EMPTY_SUMMARY), F.lit(True)))
        .when(usable, result(score, reason, score < PASS_MARK))
        .otherwise(result(F.lit(0), F.lit(EVALUATION_ERROR), F.lit(True)))
    )


def iso_time(ts: Column) -> Column:
    """ISO 8601 text; the fraction appears only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
