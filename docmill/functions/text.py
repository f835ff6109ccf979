"""Text expressions. Each one is evaluated inside a row: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BLANK_LINE = "\n\n"
SENTENCE_BREAK = r"(?<=[.!?]) +"
KEYWORD = r"(?<![\p{L}\p{N}_])[a-z]{4,}(?![\p{L}\p{N}_])"  # 4+ ASCII letters, Unicode word edges
WORD_RUN = r"([a-z]++)(?: \1(?![a-z]))*+"  # a keyword and its repeats right after it, in sorted keywords
TOKEN = r"[\p{L}\p{N}_]+"
KEYWORD_COUNT = 10
# Every character Unicode text treats as white space, with the four ASCII separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        "
    "        　"
)
_GAP = r"(?U)[\s\x1c-\x1f]+"

Expr = Callable[[Column], Column]


def let(value: Column, body: Expr) -> Column:
    """Evaluate `value` once and hand it to `body` (a one-element transform)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(text, F.lit(WHITESPACE))


def non_empty(pieces: Column) -> Column:
    return F.filter(pieces, lambda p: p != "")


def words(text: Column) -> Column:
    """White-space separated words; the default tokenizer of the chunkers."""
    return non_empty(F.split(strip(text), _GAP, -1))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscore; the search vocabulary."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """Split after '.', '!' or '?' followed by spaces."""
    return F.split(strip(text), SENTENCE_BREAK, -1)


def literal_split(text: Column, sep: str) -> Column:
    r"""Split on an exact string (`split` takes a pattern, so quote it with \Q..\E)."""
    return F.split(text, r"\Q" + sep + r"\E", -1)


def run_starts(ordered: Column, key: Expr) -> Column:
    """Positions where a sorted array begins a new run of equal keys."""
    first = F.sequence(F.lit(0), F.greatest(F.size(ordered) - 1, F.lit(0)))
    return F.filter(
        F.when(F.size(ordered) > 0, first).otherwise(F.array().cast("array<int>")),
        lambda i: (i == 0) | (key(F.get(ordered, i)) != key(F.get(ordered, i - 1))),
    )


def run_length(starts: Column, start: Column, j: Column, total: Column) -> Column:
    return F.coalesce(F.get(starts, j + 1), total) - start


def top_keywords(text: Column, limit: int = KEYWORD_COUNT) -> Column:
    """The most frequent keywords, ties by first appearance; none for a null text.

    Sorting the occurrences keeps the count inside the row; grouping exploded words by document would shuffle the
    corpus. Plain strings are sorted, and only words that come again are counted; the others follow as they appear.
    """
    def best(found: Column) -> Column:
        return let(_repeated(found), lambda counted: let(
            F.coalesce(F.get(F.sort_array(counted["n"], asc=False), F.lit(limit - 1)), F.lit(1)),
            lambda least: pick(found, counted, least)))

    def pick(found: Column, counted: Column, least: Column) -> Column:
        # fewer than `limit` words come more than `least` times; those that come so often are taken in their order
        more = F.sort_array(F.transform(F.filter(counted, lambda x: x["n"] > least), lambda x: F.struct(
            (-x["n"]).alias("order"), F.array_position(found, x["word"]).alias("first"), x["word"].alias("word"))))
        tied = F.when(least > 1, F.array_intersect(found, F.filter(counted, lambda x: x["n"] == least)["word"]))
        return F.slice(F.concat(more["word"], tied.otherwise(F.array_except(found, counted["word"]))), 1, limit)

    found = F.regexp_extract_all(F.lower(text), F.lit(KEYWORD), F.lit(0))
    return let(F.coalesce(found, F.array().cast("array<string>")), best)


def _repeated(found: Column) -> Column:
    """(word, n) of the words that come at least twice."""
    again = let(F.sort_array(found), lambda s: F.filter(s, lambda w, i: w.eqNullSafe(F.get(s, i + 1))))
    runs = F.regexp_extract_all(F.array_join(again, " "), F.lit(WORD_RUN), F.lit(0))
    return F.transform(runs, lambda r: let(F.substring_index(r, " ", 1), lambda w: F.struct(
        w.alias("word"), ((F.octet_length(r) + 1) / (F.octet_length(w) + 1) + 1).cast("int").alias("n"))))


def parse_keyword_list(answer: Column) -> Column:
    """'a, b,,c' -> [a, b, c]; no answer -> []."""
    parts = F.transform(literal_split(answer, ","), strip)
    return F.coalesce(non_empty(parts), F.array().cast("array<string>"))


def keywords(text: Column, mode: str = "fallback", answer: Column | None = None,
             limit: int = KEYWORD_COUNT) -> Column:
    """Model keywords when asked for and answered, counted keywords otherwise."""
    if mode == "llm" and answer is not None:
        return F.when(answer.isNotNull(), parse_keyword_list(answer)).otherwise(
            top_keywords(text, limit))
    return top_keywords(text, limit)


def joined_keywords(kw: Column) -> Column:
    return F.array_join(kw, ", ")


def join_summaries(ordered: Column) -> Column:
    """Non-empty summaries separated by a blank line."""
    return F.array_join(non_empty(ordered), BLANK_LINE)


def lead(text: Column, n: int = 3) -> Column:
    """First n sentences."""
    return F.array_join(F.slice(sentences(text), 1, n), " ")


def extractive_batch(text: Column, n: int = 3) -> Column:
    """`extractive` for whole Arrow batches: the tokens of a batch are counted together in numpy.

    About four times as fast; the form without Python also works inside other expressions.
    """
    @F.arrow_udf("array<int>")
    def best(tokenised: pa.Array) -> pa.Array:
        parts = tokenised.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        inside = tokenised.flatten()
        sizes = inside.value_lengths().to_numpy(zero_copy_only=False)
        words = inside.flatten().dictionary_encode()
        owner = np.repeat(np.arange(len(parts)), parts)
        first = np.cumsum(parts) - parts
        sentence = np.repeat(np.arange(len(sizes)), sizes)
        key = owner[sentence].astype(np.int64) * max(1, len(words.dictionary)) + words.indices.to_numpy()
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        scored = np.flatnonzero(sizes)
        mean = np.bincount(sentence, count[which], len(sizes))[scored] / sizes[scored]
        order = scored[np.lexsort((scored, -mean, owner[scored]))]
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        chosen = np.sort(order[rank < n])
        offsets = np.r_[0, np.cumsum(np.bincount(owner[chosen], minlength=len(parts)))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array((chosen - first[owner[chosen]]).astype(np.int32)))

    both = F.struct(best(F.transform(sentences(text), tokens)).alias("at"), sentences(text).alias("parts"))
    return let(both, lambda v: F.when(F.size(v["at"]) > 0, F.array_join(
        F.filter(v["parts"], lambda s, i: F.array_contains(v["at"], i)), " ")).otherwise(
        F.array_join(F.slice(v["parts"], 1, n), " ")))


def extractive(text: Column, n: int = 3) -> Column:
    """The n sentences whose words are on average most frequent in the text, in text order.

    Score of a sentence = mean over its tokens of the token's count in the whole text
    (Luhn 1958). All tokens are sorted once by token (to count) and once by sentence (to
    average); ties go to the earlier sentence.
    """
    def best(parts: Column) -> Column:
        tagged = F.flatten(F.transform(
            parts, lambda s, i: F.transform(tokens(s), lambda w: F.struct(w.alias("w"), i.alias("s")))))
        return let(F.sort_array(tagged), lambda occ: F.when(F.size(occ) > 0, pick(parts, occ)).otherwise(
            F.array_join(F.slice(parts, 1, n), " ")))

    def pick(parts: Column, occ: Column) -> Column:
        scored = let(F.sort_array(_weigh(occ)), _mean_by_sentence)
        chosen = F.sort_array(F.transform(F.slice(F.sort_array(scored), 1, n), lambda x: x["s"]))
        return F.array_join(F.transform(chosen, lambda i: F.get(parts, i)), " ")

    return let(sentences(text), best)


def _weigh(occ: Column) -> Column:
    """Sorted (word, sentence) occurrences -> (sentence, count of the word)."""
    return let(
        run_starts(occ, lambda x: x["w"]),
        lambda starts: F.flatten(F.transform(
            starts,
            lambda s, j: let(
                run_length(starts, s, j, F.size(occ)),
                lambda n: F.transform(F.slice(occ, s + 1, n),
                                      lambda x: F.struct(x["s"].alias("s"), n.alias("n")))),
        )),
    )


def _mean_by_sentence(occ: Column) -> Column:
    """Sorted (sentence, count) -> (minus mean, sentence), ready to be ranked."""
    def score(starts: Column, s: Column, j: Column) -> Column:
        n = run_length(starts, s, j, F.size(occ))
        total = F.aggregate(F.slice(occ, s + 1, n), F.lit(0).cast("long"),
                            lambda acc, x: acc + x["n"])
        return F.struct((-(total / n)).alias("order"), F.get(occ, s)["s"].alias("s"))

    return let(run_starts(occ, lambda x: x["s"]),
               lambda starts: F.transform(starts, lambda s, j: score(starts, s, j)))


def contains_phrase(text: Column, phrase: str) -> Column:
    """Exact token sequence: the phrase's tokens appear next to each other, in order."""
    parts = "".join(c if c.isalnum() or c == "_" else " " for c in phrase.lower()).split()
    if not parts:
        raise ValueError("a phrase needs at least one word")
    apart, inside = r"[^\p{L}\p{N}_]+", r"[\p{L}\p{N}_]"
    return F.lower(text).rlike(f"(?<!{inside})" + apart.join(parts) + f"(?!{inside})")
