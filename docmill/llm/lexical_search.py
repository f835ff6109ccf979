"""Ranked lexical search by scanning the documents with an automaton of all asked terms.

The distinct terms of a block of items become an Aho-Corasick automaton, each between two guards,
so that only whole terms match. Texts are not indexed: every task reads its texts, with all
separators turned into guards, through the automaton and counts term frequencies as they come out.
A first pass counts the documents with a term, all terms and the document frequencies; a second
scores. The outputs of the automaton map to the items that ask for the term, so a document costs
its own matches, not the number of items. A task keeps the k best documents of each item.

The items go to the tasks in blocks of a bounded number of rows and characters, two passes over
the documents each. Only a task's k best rows per item are shuffled. All arithmetic but the
logarithm is in whole numbers, so scores do not depend on the order of rows or tasks.

Defined results: null texts, and texts without a term, have no terms: such documents count for
nothing, such items have no hits. Rows of items that repeat an id and a text are one item; one id
with differing texts is ranked for each text. Rows of documents that share an id are ranked each;
rows without an id come last among equal scores. Equal scores go by ascending id. Other columns
are not looked at. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from docmill.llm.decontamination import WORD_BYTES, words_of
from docmill.operators.topk import passes

TOP = 50
#: A block of items has about this many rows and characters at most.
BLOCK_ITEMS, BLOCK_CHARS = 2048, 4_000_000
#: Documents whose scores a task holds before it keeps the best.
HELD = 256
N_DOCS, N_TERMS = -1, -2


class Asked:
    """The terms of a block of items, and the items that ask for each."""

    def __init__(self, item_ids: pa.Array, texts: list[str | None]):
        self.item_ids = item_ids
        owners: dict[bytes, list[int]] = {}
        for item, text in enumerate(texts):
            for term in dict.fromkeys(words_of(text)):
                owners.setdefault(term, []).append(item)
        self.terms = list(owners)
        self.counts = np.array([len(o) for o in owners.values()], np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.items = np.array([i for o in owners.values() for i in o], np.int64)

    def automaton(self) -> ahocorasick.Automaton:
        """All terms between guards; bytes stand for characters, so that any UTF-8 text goes through."""
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, term in enumerate(self.terms):
            found.add_word(f" {term.decode('latin-1')} ", number)
        found.make_automaton()
        return found


def term_counts(automaton: ahocorasick.Automaton, text: bytes | None) -> tuple[int, Counter]:
    """The number of terms of a text, and the frequencies of the asked ones."""
    guarded = (text or b"").translate(WORD_BYTES)
    n = len(guarded.split())
    if not n or not len(automaton):
        return n, Counter()
    return n, Counter(map(itemgetter(1), automaton.iter(f" {guarded.decode('latin-1')} ")))


def counter(asked):
    """Per task: documents with a term, all terms, document frequencies."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, size = asked.value.automaton(), len(asked.value.terms)
        df, docs, terms = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for text in batch.column(1):
                n, tf = term_counts(automaton, text.as_py())
                docs, terms = docs + (n > 0), terms + n
                df[list(tf)] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[N_DOCS, N_TERMS, held], pa.int64()), pa.array(np.r_[docs, terms, df[held]], pa.int64())],
            ["term", "n"])
    return of


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The k best documents of each item so far: score, then id, rows without an id last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores = np.zeros((0, items), np.int64)
        self.ids = np.zeros((0, items), np.int64)
        self.no_id = np.zeros((0, items), bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        wide = np.broadcast_to
        scores = np.concatenate([self.scores, scores])
        ids = np.concatenate([self.ids, wide(ids[:, None], (len(ids), scores.shape[1]))])
        no_id = np.concatenate([self.no_id, wide(no_id[:, None], (len(no_id), scores.shape[1]))])
        order = np.lexsort((ids, no_id, -scores), axis=0)[:self.k]
        self.scores, self.ids, self.no_id = (np.take_along_axis(x, order, 0) for x in (scores, ids, no_id))


def scorer(asked, weights: np.ndarray, n_docs: int, n_terms: int, k: int, names: list[str]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, automaton = asked.value, asked.value.automaton()
        items = len(block.item_ids)
        best = Best(items, k)
        scores, ids = np.zeros((HELD, items), np.int64), []

        def keep():
            known = np.array([0 if i is None else i for i in ids], np.int64)
            best.add(scores[:len(ids)], known, np.array([i is None for i in ids], bool))
            scores[:] = 0
            ids.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, tf = term_counts(automaton, text.as_py())
                if not tf:
                    continue
                found = np.fromiter(tf.keys(), np.int64, len(tf))
                times = np.fromiter(tf.values(), np.int64, len(tf))
                m = 100 - 50 + 50 * n * n_docs // n_terms
                gain = weights[found] * (1_000_000_000 * times // (1000 * times + 20 * m))
                counts = block.counts[found]
                ends = np.cumsum(counts)
                owners = block.items[np.arange(ends[-1]) + np.repeat(block.first[found] - ends + counts, counts)]
                np.add.at(scores[len(ids)], owners, np.repeat(gain, counts))
                ids.append(doc_id)
                if len(ids) == HELD:
                    keep()
        keep()
        at, item = np.nonzero(best.scores > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), block.item_ids.take(pa.array(item)),
             pa.array(best.ids[at, item], pa.int64(), mask=best.no_id[at, item]),
             pa.array(best.scores[at, item], pa.int64())], names)
    return of


def best_of_block(rows: DataFrame, items: pa.Table, item_id, k: int) -> DataFrame:
    """item (number in the block), item_id, doc_id, score, rank of the k best rows of each item."""
    context = rows.sparkSession.sparkContext
    block = Asked(items["item_id"].combine_chunks(), items["text"].to_pylist())
    asked = context.broadcast(block)
    totals = rows.mapInArrow(counter(asked), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counted = {r.term: r.n for r in totals.collect()}  # at most one row per term of the block
    n_docs, n_terms = counted.get(N_DOCS, 0), counted.get(N_TERMS, 0)
    weights = np.array([weight(n_docs, counted.get(t, 0)) for t in range(len(block.terms))], np.int64)
    schema = StructType([StructField("item", IntegerType()), item_id, StructField("doc_id", LongType()),
                         StructField("score", LongType())])
    hits = rows.mapInArrow(scorer(asked, weights, n_docs, max(n_terms, 1), k, schema.names), schema)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_items: int = BLOCK_ITEMS,
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of `docs` (doc_id, text) for each of `items` (item_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    asked = items.select("item_id", "text").distinct()
    size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-size[0] // block_items), -(-size[1] // block_chars))

    def results():
        for block in range(blocks):
            own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
            yield best_of_block(rows, own.toArrow(), asked.schema["item_id"], k)
    return passes(results(), "lexical-search").select("item_id", "rank", "doc_id", "score")
