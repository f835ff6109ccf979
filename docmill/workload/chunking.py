"""Chunkers over every document."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from docmill.functions.text import words
from docmill.operators import token_slices
from docmill.operators.chunking import OVERLAP, OVERLAP_CHARS, SEPARATORS, chunk
from docmill.session import small_batches, staged
from docmill.workload.fixtures import (NL, SQL_SENTENCES, SQL_STRIP, SQL_WORDS, documents, rows_of)
from docmill.workload.registry import query


def pack_by_chars(pieces: str, size: int, sep: str) -> str:
    """Greedy packing spelled out on strings: the current chunk keeps its trailing separator."""
    empty = "{'p': '', 'cur': '', 'done': []::VARCHAR[]}"
    fold = f"""list_reduce(list_prepend({empty},
      list_transform({pieces}, lambda p: {{'p': p, 'cur': '', 'done': []::VARCHAR[]}})),
      lambda a, x: CASE WHEN length(a.cur) + length(x.p) + length({sep}) <= {size}
        THEN {{'p': '', 'cur': a.cur || x.p || {sep}, 'done': a.done}}
        ELSE {{'p': '', 'cur': x.p || {sep}, 'done': CASE WHEN a.cur <> '' THEN list_append(a.done, a.cur) ELSE a.done END}} END)"""
    done = "CASE WHEN r.cur <> '' THEN list_append(r.done, r.cur) ELSE r.done END"
    return rows_of(f"list_transform({done}, lambda c: {SQL_STRIP.format('c')})",
                   f"(SELECT doc_id, {fold} AS r FROM documents)")


def pack_by_cost(pieces: str, cost: str, size: int, sep: str) -> str:
    """Greedy packing on lists: a full chunk is emitted even when it is still empty."""
    empty = "{'p': '', 'n': 0, 'cur': [], 'done': []::VARCHAR[]}"
    fold = f"""list_reduce(list_prepend({empty.replace("[],", "[]::VARCHAR[],")},
      list_transform({pieces}, lambda p: {{'p': p, 'n': 0, 'cur': []::VARCHAR[], 'done': []::VARCHAR[]}})),
      lambda a, x: CASE WHEN a.n + {cost.format('x.p')} > {size}
        THEN {{'p': '', 'n': CAST({cost.format('x.p')} AS INTEGER), 'cur': [x.p], 'done': list_append(a.done, array_to_string(a.cur, {sep}))}}
        ELSE {{'p': '', 'n': CAST(a.n + {cost.format('x.p')} AS INTEGER), 'cur': list_append(a.cur, x.p), 'done': a.done}} END)"""
    done = f"CASE WHEN len(r.cur) > 0 THEN list_append(r.done, array_to_string(r.cur, {sep})) ELSE r.done END"
    return rows_of(done, f"(SELECT doc_id, {fold} AS r FROM documents)")


def windows(pieces: str, n: int, sep: str) -> str:
    return rows_of(f"list_transform(range(0, len(ps), {n}), lambda s: array_to_string(ps[s + 1:s + {n}], {sep}))",
                   f"(SELECT doc_id, {pieces} AS ps FROM documents)")


LINES = "string_split(text, chr(10))"


@query(rows_of(LINES))
def chunk_paragraph_raw(spark, sf):
    return chunk(documents(spark, sf), "paragraph_raw", sep=NL)


@query(rows_of(f"list_filter(list_transform({LINES}, lambda p: {SQL_STRIP.format('p')}), lambda p: p <> '')"))
def chunk_paragraph_clean(spark, sf):
    return chunk(documents(spark, sf), "paragraph_clean", sep=NL)


@query(pack_by_chars(LINES, 1000, "chr(10)"))
def chunk_paragraph_pack(spark, sf):
    return chunk(documents(spark, sf), "paragraph", sep=NL)


@query(pack_by_cost(SQL_WORDS.format("text"), "(length({0}) + 1)", 200, "' '"))
def chunk_words(spark, sf):
    return chunk(documents(spark, sf), "fixed_char", size=200)


@query(rows_of(SQL_SENTENCES.format("text")))
def chunk_sentences(spark, sf):
    from pyspark.sql import functions as F

    from docmill.functions.text import sentences
    from docmill.operators.chunking import exploded
    return exploded(documents(spark, sf), sentences(F.col("text")), "doc_id")


@query(pack_by_chars(SQL_SENTENCES.format("text"), 1000, "' '"))
def chunk_sentence_pack(spark, sf):
    return chunk(documents(spark, sf), "sentence")


@query(windows(SQL_WORDS.format("text"), 100, "' '"))
def chunk_token_windows(spark, sf):
    return chunk(documents(spark, sf), "token", size=100, tokenizer=words)


@query(pack_by_cost(LINES, f"len({SQL_WORDS})", 100, "chr(10)"))
def chunk_token_pack(spark, sf):
    return chunk(documents(spark, sf), "paragraph_token", size=100, sep=NL)


@query(windows(LINES, 3, "chr(10)"))
def chunk_lines(spark, sf):
    return chunk(documents(spark, sf), "lines", lines=3)


@query(rows_of("list_transform(range(0, greatest(length(text) - 200, 1), 1800), "
               "lambda s: substr(text, s + 1, 2000))"))
def chunk_overlap(spark, sf):
    return chunk(documents(spark, sf), "overlap")


def by_separators(size: int, overlap: int, separators: tuple[str, ...]) -> str:
    """Split level by level into pieces with their group, then join neighbours of a group by positions."""
    ctes = ["l0 AS (SELECT doc_id, [{'p': text, 'g': ''}] AS ps FROM documents)"]
    for level, sep in enumerate(separators):
        lit = " || ".join("chr(10)" if c == chr(10) else f"'{c}'" for c in sep)
        parts = "regexp_extract_all(x.p, '(?s).')" if sep == "" else f"""list_filter(list_transform(string_split(x.p, {lit}),
        lambda y, j: CASE WHEN j = 1 THEN y ELSE {lit} || y END), lambda y: y <> '')"""
        ctes.append(f"""l{level + 1} AS (SELECT doc_id, flatten(list_transform(ps, lambda x, i: CASE WHEN length(x.p) < {size} THEN [x]
      ELSE list_transform({parts}, lambda y: {{'p': y, 'g': x.g || '/{level}:' || i}}) END)) AS ps FROM l{level})""")
    state = "'n': {0}, 'g': {1}, 'first': {2}, 'held': {3}, 'at': {4}, 'out': {5}"
    empty = "[]::STRUCT(a BIGINT, b BIGINT)[]"
    row = state.format("length(x.p)::BIGINT", "x.g", "0::BIGINT", "0::BIGINT", "0::BIGINT", empty)
    zero = state.format("0::BIGINT", "''", "0::BIGINT", "0::BIGINT", "0::BIGINT", empty)
    done = "list_append(a.out, {'a': a.first, 'b': a.at})"
    tail = "list_sum(sizes[a.at - k + 1:a.at])"
    carried = f"list_filter(range(1, a.at - a.first + 1), lambda k: {tail} <= {overlap} AND {tail} + x.n <= {size})"
    held = f"coalesce(list_sum(sizes[a.at - len({carried}) + 1:a.at]), 0)"

    def turn(first: str, kept: str, out: str) -> str:
        return "{" + state.format("x.n", "x.g", f"({first})::BIGINT", f"({kept} + x.n)::BIGINT", "(a.at + 1)::BIGINT", out) + "}"
    fold = f"""list_reduce(list_prepend({{{zero}}}, list_transform(ps, lambda x: {{{row}}})), lambda a, x:
      CASE WHEN a.at > 0 AND x.g <> a.g THEN {turn('a.at', '0', done)}
           WHEN a.held + x.n > {size} AND a.at > a.first THEN {turn(f'a.at - len({carried})', held, done)}
           ELSE {turn('a.first', 'a.held', 'a.out')} END)"""
    chunks = f"""list_filter(list_transform(CASE WHEN r.at > r.first THEN list_append(r.out, {{'a': r.first, 'b': r.at}}) ELSE r.out END,
      lambda w: {SQL_STRIP.format("array_to_string(list_transform(ps[w.a + 1:w.b], lambda y: y.p), '')")}), lambda c: c <> '')"""
    last = f"""cuts AS (SELECT doc_id, list_filter(ps, lambda x: x.p <> '') AS ps FROM l{len(separators)}),
folded AS (SELECT doc_id, ps, {fold} AS r FROM (SELECT *, list_transform(ps, lambda x: length(x.p)) AS sizes FROM cuts))"""
    return f"WITH {', '.join(ctes)}, {last} {rows_of(chunks, 'folded')}"


@query(by_separators(OVERLAP_CHARS, OVERLAP, SEPARATORS))
def chunk_separators(spark, sf):
    return chunk(documents(spark, sf), "separators")


@query("SELECT doc_id, md5(text) AS digest, TRUE AS filled FROM documents WHERE text <> ''")
def chunk_token_slices(spark, sf):
    """Windows of 512 tokens of a public vocabulary, put together again: they are the text."""
    import public_tokenizers
    vocabulary = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    windows = token_slices.token_slices(F.col("text"), token_slices.library_starts(vocabulary))
    whole = documents(spark, sf).where("text <> ''").select("doc_id", windows.alias("w")).select(
        "doc_id", F.md5(F.array_join("w", "")).alias("digest"),
        F.forall("w", lambda w: F.length(w) > 0).alias("filled"))
    with small_batches(spark):
        return staged(whole, "slices")
