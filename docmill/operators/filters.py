"""Chunk filters. All are scan-side predicates; a falsy bound means no bound."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.text import contains_phrase
from docmill.operators.topk import BLOCK_BYTES, BLOCK_ROWS, blocks_of, first_k, passes

# Declared column widths.
SUMMARY_COLLECTION_WIDTHS = {"summary": 1024, "source_doc": 256, "acl": 128, "bm25": 1024}
ENHANCED_COLLECTION_WIDTHS = {"doc_id": 64, "summary": 4096, "keyword": 256}
MIN_CHARS = 100


def has_keyword(keyword: Column, summary: Column) -> Column:
    return F.contains(F.lower(F.coalesce(summary, F.lit(""))), F.lower(keyword))


def of_documents(chunks: DataFrame, doc_ids: DataFrame | list) -> DataFrame:
    """Rows of the given documents: a list, or a table with doc_id."""
    if isinstance(doc_ids, DataFrame):
        return chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return chunks.where(F.col("doc_id").isin(list(doc_ids)))


def matching(chunks: DataFrame, keyword: str | None = None, acl: str | None = None,
             min_time: int | None = None, max_time: int | None = None) -> DataFrame:
    """Keyword, access and time filters; a missing time counts as 0."""
    if acl:
        chunks = chunks.where(F.col("acl") == acl)
    if keyword:
        chunks = chunks.where(has_keyword(F.lit(keyword), F.col("summary")))
    if min_time:
        chunks = chunks.where(F.col("ts") >= min_time)  # a missing time is 0, below any bound
    if max_time:
        chunks = chunks.where(F.coalesce("ts", F.lit(0)) <= max_time)
    return chunks


def matching_queries(chunks: DataFrame, queries: DataFrame, order: tuple[str, ...] = ("doc_id", "chunk_id"),
                     carry: tuple[str, ...] = (), k: int | None = None, block_rows: int = BLOCK_ROWS,
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Hits of many keyword queries (qid, keyword, acl, min_time, max_time): (qid, *order, *carry, matched).

    With `k` a task gives at least the first k hits per query in the given order, without it
    all of them. `matched` adds up to the number of all hits of a query, however many are given.

    Queries are broadcast in blocks of a bounded size. A kernel looks for all keywords of the block
    in one pass over a text; a frequent keyword costs k rows per task, and no text moves.
    """
    asks = queries.select(
        "qid", F.lower(F.coalesce("keyword", F.lit(""))).alias("keyword"), F.coalesce("acl", F.lit("")).alias("acl"),
        F.coalesce("min_time", F.lit(0)).cast("bigint").alias("min_time"),
        F.coalesce("max_time", F.lit(0)).cast("bigint").alias("max_time"))
    kept = [*dict.fromkeys([*order, *carry])]
    rows = chunks.select(
        F.struct(*kept).alias("row"), F.lower(F.coalesce("summary", F.lit(""))).alias("low"),
        F.coalesce("acl", F.lit("")).alias("acl"), F.coalesce("ts", F.lit(0)).cast("bigint").alias("ts"))
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType),
                           *[T.StructField(c, chunks.schema[c].dataType) for c in kept],
                           T.StructField("matched", T.LongType())])
    context = chunks.sparkSession.sparkContext

    def one(block: pa.Table) -> DataFrame:
        return rows.mapInArrow(_find(context.broadcast(block), list(order), kept, k, schema.names), schema)

    return passes((one(b) for b in blocks_of(asks, "qid", block_rows, block_bytes)), "matches")


def _find(block, order: list[str], kept: list[str], k: int | None, names: list[str]):
    def asked(table: pa.Table) -> dict[str, list[tuple]]:
        by_keyword: dict[str, list[tuple]] = {}
        columns = (table[c].to_pylist() for c in ("keyword", "acl", "min_time", "max_time"))
        for q, (keyword, *bounds) in enumerate(zip(*columns)):
            by_keyword.setdefault(keyword, []).append((q, *bounds))
        return by_keyword

    def searcher(keywords: list[str]):
        """All keywords in one pass over a text (Aho & Corasick 1975)."""
        machine = ahocorasick.Automaton()
        for i, keyword in enumerate(keywords):
            if keyword:
                machine.add_word(keyword, i)
        machine.make_automaton()

        def rows_by_keyword(texts: list[str]) -> Iterator[tuple[str, np.ndarray]]:
            found: list[list[int]] = [[] for _ in keywords]
            if len(machine):
                for row, text in enumerate(texts):
                    for i in {i for _, i in machine.iter(text)}:
                        found[i].append(row)
            for keyword, rows in zip(keywords, found):
                yield keyword, np.array(rows, np.int64) if keyword else np.arange(len(texts))

        return rows_by_keyword

    def hits(batch: pa.RecordBatch, by_keyword: dict[str, list[tuple]], rows_by_keyword):
        """(query, rows) of every query with a hit in the batch."""
        ts = batch.column("ts").to_numpy()
        groups = batch.column("acl").dictionary_encode()
        group, number = groups.indices.to_numpy(), {a: i for i, a in enumerate(groups.dictionary.to_pylist())}
        for keyword, found in rows_by_keyword(batch.column("low").to_pylist()):
            for q, acl, least, most in by_keyword[keyword] if len(found) else ():
                own = found
                if acl:
                    own = own[group[own] == number.get(acl, -1)]
                if least:
                    own = own[ts[own] >= least]
                if most:
                    own = own[ts[own] <= most]
                if len(own):
                    yield q, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = block.value
        by_keyword = asked(table)
        rows_by_keyword = searcher(list(by_keyword))
        total, held = np.zeros(table.num_rows, np.int64), None

        def given(rows: pa.Table, matched: np.ndarray) -> list[pa.RecordBatch]:
            rows = rows.append_column("qid", table["qid"].take(rows["q"])).append_column("matched", pa.array(matched))
            return rows.select(names).to_batches()

        for batch in batches:
            found = list(hits(batch, by_keyword, rows_by_keyword))
            if not found:
                continue
            row = batch.column("row")
            rows = pa.table({c: row.field(c) for c in kept})
            if k is not None:  # places in the order, so that only k rows per query are taken
                place = np.empty(len(row), np.int64)
                place[pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order]).to_numpy()] = np.arange(len(row))
            q = np.concatenate([np.full(len(own) if k is None else min(k, len(own)), i) for i, own in found])
            at = np.concatenate([own if k is None or len(own) <= k else own[np.argpartition(place[own], k - 1)[:k]]
                                 for _, own in found])
            for i, own in found:
                total[i] += len(own)
            fresh = rows.take(pa.array(at)).append_column("q", pa.array(q))
            if k is None:
                yield from given(fresh, np.ones(len(q), np.int64))
            else:
                held = first_k(fresh if held is None else pa.concat_tables([held, fresh]), order, k)
        if held is not None:  # the first row of each query carries the count of its hits
            q = held["q"].to_numpy()
            yield from given(held, np.where(np.r_[True, q[1:] != q[:-1]], total[q], 0))

    return run


def with_any_tag(df: DataFrame, tags: list[str], column: str = "keywords") -> DataFrame:
    # coalesce keeps Catalyst from adding a null test that would compute the tags a second time
    found = F.arrays_overlap(F.col(column), F.array(*[F.lit(t) for t in tags]))
    return df.where(F.coalesce(found, F.lit(False)))


def with_tag(df: DataFrame, tag: str, column: str = "keywords") -> DataFrame:
    return df.where(F.coalesce(F.array_contains(column, tag), F.lit(False)))


def with_phrase(df: DataFrame, phrase: str, column: str = "text") -> DataFrame:
    return df.where(contains_phrase(F.col(column), phrase))


def long_enough(df: DataFrame, chars: int = MIN_CHARS, column: str = "text") -> DataFrame:
    return df.where(F.length(column) >= chars)


def width_violations(df: DataFrame, widths: dict[str, int], id_col: str) -> DataFrame:
    """(id, column, size, width) for every value longer than its declared width; one scan."""
    checks = F.array(*[F.struct(F.lit(c).alias("column"), F.length(F.col(c).cast("string")).alias("size"),
                                F.lit(w).alias("width")) for c, w in widths.items()])
    return (df.select(id_col, F.explode(F.filter(checks, lambda x: x["size"] > x["width"])).alias("v"))
            .select(id_col, "v.*"))


def without_documents(df: DataFrame, doc_ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Everything but the given documents (or sessions)."""
    return df.join(doc_ids.select(key).distinct(), key, "left_anti")


def without_prefix(df: DataFrame, prefix: str, column: str = "vector_id") -> DataFrame:
    """Drop ids that start with a literal prefix."""
    return df.where(~F.col(column).startswith(prefix))
