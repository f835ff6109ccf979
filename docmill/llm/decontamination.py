"""Benchmark decontamination with an FM-index per shard of the training documents.

A task reads its partition in shards of a bounded number of words. The words of a shard become a
sequence of numbers, in which a word of no test phrase is a separator; runs between separators
that are too short for any phrase are left out, since no phrase can occur there. The sequence is
suffix-sorted and its Burrows-Wheeler transform stored as a wavelet tree of packed bits. All test
phrases are searched backwards together, one word a step, through ranks in the tree; occurrences
are located by walking back to sampled suffix positions, and their spans of words are merged.

A phrase is a window of `window` consecutive words of an item, or the whole of a shorter item.
The test set goes to the tasks in blocks of a bounded number of characters, one pass over the
documents each; spans found so far travel with the rows. Nothing is shuffled.

Defined results: null and wordless texts have no words and no hits; null and wordless items have
no phrases. Items without an id mark words but are not counted; items that share an id count
once. Repeated rows are judged each. Other columns are kept by `apply` and otherwise not looked at.
Empty tables give an empty result, an empty test set leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from docmill.llm.common import LOWER, UPPER, whole_rows
from docmill.session import staged

WINDOW = 13
SHARD_WORDS = 2_000_000
SAMPLE = 32
BLOCK_CHARS = 8_000_000
SPAN = StructType([StructField("start", LongType()), StructField("stop", LongType())])

#: Byte table: A-Z in lower case, a-z, digits and bytes beyond ASCII as they are, all else a space.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or chr(b) in LOWER else LOWER.encode()[b - 65]
                   if chr(b) in UPPER else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Phrases:
    """The distinct windows of a block of items, as rows of word numbers from 1 on, by their length."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        number, owners = self.vocabulary, {}
        for item_id, text in items:
            ids = [number.setdefault(w, len(number) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owner = owners.setdefault(tuple(ids[at:at + window]), set())
                if item_id is not None:
                    owner.add(str(item_id))
        ordered = sorted(owners, key=lambda w: (len(w), w))
        self.items = [sorted(owners[w]) for w in ordered]
        self.lengths = np.array([len(w) for w in ordered], np.int64)
        self.by_length = {int(n): np.array([w for w in ordered if len(w) == n], np.int64) for n in set(self.lengths.tolist())}


class BitRanks:
    """Packed bits with the number of ones before any position."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.r_[bits, np.zeros(64 - len(bits) % 64, bool)], bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; zeros are separators, each smaller than the next one.

    Rounds end after the longest run between separators; only suffixes still tied are sorted again.
    """
    n = len(symbols)
    separators = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(separators)
    rank[separators] = np.arange(len(separators))
    order = np.argsort(rank, kind="stable")
    ordered = rank[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = group  # a suffix's rank is the first place of its group
    tied = ~(first & np.r_[first[1:], True])
    step = 1
    while tied.any():
        at = np.flatnonzero(tied)
        own, after = group[at], np.zeros(len(at), np.int64)
        behind = order[at] + step
        after = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1)
        sort = np.lexsort((after, own))
        order[at] = order[at][sort]
        own, after = own[sort], after[sort]
        first = np.r_[True, (own[1:] != own[:-1]) | (after[1:] != after[:-1])]
        new = np.maximum.accumulate(np.where(first, at, 0))
        group[at] = new
        rank[order[at]] = new
        tied[at] = ~(first & np.r_[first[1:], True])
        step *= 2
    return order


class FMIndex:
    """Counts and locates sequences of symbols from 1 on in `symbols`, in which zeros are separators."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        n = self.size = len(symbols)
        order = suffix_order(symbols)
        transform = symbols[order - 1]  # the first suffix is preceded by the last symbol, a separator
        counts = np.bincount(symbols)
        self.start = np.r_[0, np.cumsum(counts)]
        self.tree, self.depth = [], max(1, int(len(counts) - 1).bit_length())
        level = transform
        for bit in reversed(range(self.depth)):
            ones = (level >> bit & 1).astype(bool)
            self.tree.append(BitRanks(ones))
            level = np.r_[level[~ones], level[ones]]
        # where each symbol's block begins in the tree's last level
        self.block = np.zeros(len(counts), np.int64)
        present, first = np.unique(level, return_index=True)
        self.block[present] = first
        # walks back never pass a separator: suffixes behind one are sampled too
        sampled = (order % sample == 0) | (transform == 0)
        self.sampled, self.positions = BitRanks(sampled), order[sampled]

    def before(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is in the transform before each place."""
        for bit, ranks in zip(reversed(range(self.depth)), self.tree):
            ones = ranks.ones(at)
            at = np.where(symbol >> bit & 1, ranks.zeros + ones, at - ones)
        return at - self.block[symbol]

    def back(self, at: np.ndarray) -> np.ndarray:
        """The places of the suffixes one symbol longer."""
        symbol = np.zeros(len(at), np.int64)
        for ranks in self.tree:
            bit, ones = ranks.get(at), ranks.ones(at)
            at = np.where(bit, ranks.zeros + ones, at - ones)
            symbol = symbol << 1 | bit
        return self.start[symbol] + at - self.block[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search for all rows of `patterns`: the ranges of suffixes that begin with them."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        live = np.flatnonzero((patterns < len(self.block)).all(axis=1))
        high[np.setdiff1d(np.arange(len(patterns)), live)] = 0
        for step in reversed(range(patterns.shape[1])):
            symbol = patterns[live, step]
            low[live] = self.start[symbol] + self.before(symbol, low[live])
            high[live] = self.start[symbol] + self.before(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, places: np.ndarray) -> np.ndarray:
        """The positions of suffixes, by their places in the suffix order."""
        at, steps = places.copy(), np.zeros(len(places), np.int64)
        walking = np.flatnonzero(~self.sampled.get(at))
        while len(walking):
            at[walking] = self.back(at[walking])
            steps[walking] += 1
            walking = walking[~self.sampled.get(at[walking])]
        return self.positions[self.sampled.ones(at)] + steps


def occurrences(numbers: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Positions in `numbers` (0: a word of no phrase) and phrase indices of all occurrences."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.lengths):
        return none
    known = np.r_[False, numbers > 0, False]
    edges = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
    runs = edges[edges[:, 1] - edges[:, 0] >= phrases.lengths.min()]
    if not len(runs):
        return none
    sizes = runs[:, 1] - runs[:, 0] + 1  # with the separator behind each run
    ends = np.cumsum(sizes)
    inside = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    source = np.repeat(runs[:, 0], sizes) + inside
    last = ends - 1
    symbols = numbers[np.minimum(source, len(numbers) - 1)].astype(np.int64)
    symbols[last] = 0
    index = FMIndex(symbols)
    at, which, first = [], [], 0
    for length in sorted(phrases.by_length):
        low, high = index.search(phrases.by_length[length])
        found = high - low
        places = np.repeat(low, found) + np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
        at.append(source[index.locate(places)])
        which.append(first + np.repeat(np.arange(len(found)), found))
        first += len(found)
    return np.concatenate(at), np.concatenate(which)


def marker(phrases: Phrases, shard_words: int):
    """Adds the block's hits to rows (row, text, n_words, spans, items)."""
    number = phrases.vocabulary

    def shard(parts: list[tuple[pa.RecordBatch, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        docs = [ids for _, own in parts for ids in own]
        sizes = np.array([len(d) + 1 for d in docs], np.int64)  # a separator behind each document
        starts = np.cumsum(sizes) - sizes
        numbers = np.zeros(int(sizes.sum()), np.int64)
        for start, ids in zip(starts, docs):
            numbers[start:start + len(ids)] = ids
        at, which = occurrences(numbers, phrases)
        length = phrases.lengths[which]
        earlier = [list_column(batch.column(3)) for batch, _ in parts]
        base = np.cumsum([0, *[len(own) for _, own in parts]])
        for b, (counts, spans) in zip(base, earlier):
            offset = np.repeat(starts[b:b + len(counts)], counts)
            at = np.r_[at, offset + spans[:, 0]]
            length = np.r_[length, spans[:, 1] - spans[:, 0]]
        size = len(numbers) + 1
        depth = np.cumsum(np.bincount(at, minlength=size) - np.bincount(at + length, minlength=size))
        hit = np.r_[False, depth > 0, False]
        merged = np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2)  # no span passes a document's separator
        doc_of = np.searchsorted(starts, merged[:, 0], "right") - 1
        merged = merged - starts[doc_of][:, None]
        names: list[set] = [set(x) for batch, _ in parts for x in batch.column(4).to_pylist()]
        owner = np.searchsorted(starts, at[:len(which)], "right") - 1
        for doc, phrase in np.unique(np.stack([owner, which], axis=1), axis=0).tolist():
            names[doc].update(phrases.items[phrase])
        cuts = np.searchsorted(doc_of, np.arange(len(docs) + 1))
        for b, (batch, own) in zip(base, parts):
            rows = slice(b, b + len(own))
            low, high = cuts[b], cuts[b + len(own)]
            spans = pa.ListArray.from_arrays(
                pa.array(cuts[b:b + len(own) + 1] - low, pa.int32()),
                pa.StructArray.from_arrays([pa.array(merged[low:high, 0]), pa.array(merged[low:high, 1])],
                                           ["start", "stop"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(d) for d in own], pa.int64()), spans,
                 pa.array([sorted(x) for x in names[rows]], pa.list_(pa.string()))],
                ["row", "text", "n_words", "spans", "items"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, none = [], 0, repeat(0)
        for batch in batches:
            own, first = [], 0
            for i, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                own.append(np.fromiter(map(number.get, words, none), np.int32, len(words)))
                held += len(words)
                if held >= shard_words:
                    yield from shard([*parts, (batch.slice(first, i + 1 - first), own)])
                    parts, held, own, first = [], 0, [], i + 1
            if own:
                parts.append((batch.slice(first), own))
        if parts:
            yield from shard(parts)
    return of


def list_column(spans: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of spans of each row, and all spans."""
    flat = spans.flatten()
    ends = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], axis=1).astype(np.int64)
    return spans.value_lengths().to_numpy(), ends.reshape(-1, 2)


def marked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS,
           shard_words: int = SHARD_WORDS) -> DataFrame:
    """row (a struct of the columns of `docs`), text, n_words, spans (merged, in words), items (ids as strings)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    rows = whole_rows(docs).select(
        "row", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(ArrayType(SPAN)).alias("spans"),
        F.array().cast(ArrayType(StringType())).alias("items"))
    schema = rows.schema
    for block in range(blocks):
        # a block holds about block_chars characters, whatever the size of the test set
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        if block:
            rows = staged(rows, "decontamination")
        rows = rows.mapInArrow(marker(Phrases([tuple(x) for x in own], window), shard_words), schema)
    return rows


def hits(rows: DataFrame) -> DataFrame:
    """`marked` rows with n_hit and contaminated."""
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return rows.withColumn("n_hit", covered).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items, contaminated: one row per row of `docs` (doc_id, text)."""
    rows = hits(marked(docs.select("doc_id", "text"), benchmark, window))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", "spans", "items", "contaminated")


def apply(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` that are not contaminated."""
    return hits(marked(docs, benchmark, window)).where(~F.col("contaminated")).select("row.*")
