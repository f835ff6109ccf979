"""Periodic run detection with longest common extensions over a difference cover.

A run is a stretch of words with smallest period q, at least twice as long as q, that no word
beside it extends. Every run with period q covers two neighbouring points of the grid 0, q, 2q,
... of its document, so the pairs (i, i + q) of all grids, n log n of them, find every run: the
words at i and i + q are equal, and the longest common extensions to both sides are the run.

Extensions are answered in constant time. Of all suffixes only those are sorted whose position
modulo 13 is in a difference cover; for any two positions a shift below 13 exists that takes both
to the cover. So a query compares less than 13 words and then takes the minimum of the common
prefixes between two ranks from a sparse table. Extensions to the left use the reversed words.

A task works on slices of its documents, whose words are numbered and laid end to end with a
separator of its own between any two documents; all steps are array operations over a slice. A
document longer than a slice is a slice by itself, and its grid is walked in bounded blocks.
Nothing is shuffled.

Defined results: null, empty and wordless texts have no words and no runs. Rows without an id
and repeated rows are judged each. A stretch with several periods counts once, with the smallest.
Other columns are not looked at. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from docmill.llm.common import SPACES

MIN_LENGTH = 12
#: The differences of the cover's members give all numbers modulo 13.
PERIOD, COVER = 13, np.array([0, 1, 3, 9])
SLICE_BYTES = 1 << 20
BLOCK_PAIRS = 1 << 20
RUN = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES.encode())] = True
#: The place of a residue in the cover, and the least shift that takes two residues into it.
PLACE = np.full(PERIOD, -1)
PLACE[COVER] = np.arange(len(COVER))
SHIFT = np.array([[next(d for d in range(PERIOD) if PLACE[(i + d) % PERIOD] >= 0 and PLACE[(j + d) % PERIOD] >= 0)
                   for j in range(PERIOD)] for i in range(PERIOD)])


def ranks_of(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 on; `keys` may be one column or several, the first weighing most."""
    order = np.lexsort(keys[::-1]) if keys.ndim == 2 else np.argsort(keys, kind="stable")
    own = keys[..., order]
    new = own[..., 1:] != own[..., :-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(np.r_[True, new.any(axis=0) if keys.ndim == 2 else new])
    return ranks


class Extensions:
    """Longest common extensions to the right within a sequence of numbers from 0 on.

    Two positions that are compared must run into different numbers before the end.
    """

    def __init__(self, numbers: np.ndarray):
        self.numbers, size, per = numbers, len(numbers), len(COVER)
        padded = np.r_[numbers + 1, np.zeros(2 * PERIOD, np.int64)]
        starts = (np.arange(-(-size // PERIOD))[:, None] * PERIOD + COVER).ravel()
        self.samples = starts[starts < size]  # the last block may be cut, earlier ones are whole
        m = len(self.samples)
        bits = max(1, int(padded.max()).bit_length())
        width = max(1, 62 // bits)
        columns = []
        for first in range(0, PERIOD, width):
            column = np.zeros(m, np.int64)
            for t in range(first, min(first + width, PERIOD)):
                column = column << bits | padded[self.samples + t]
            columns.append(column)
        # ranks by PERIOD words, then by twice as many in each round: a sample's successor is `per` places on
        levels = [ranks_of(np.stack(columns))]
        while levels[-1].max(initial=0) < m:
            last, step = levels[-1], per << (len(levels) - 1)
            after = np.r_[last[step:], np.zeros(min(step, m), np.int64)]
            levels.append(ranks_of(last * (m + 1) + after))
        self.rank = levels[-1] - 1
        order = np.empty(m, np.int64)
        order[self.rank] = np.arange(m)
        self.table = self.minima(self.common(order[:-1], order[1:], levels[:-1]))

    def common(self, a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that the suffixes of two samples share: whole blocks by their ranks, then single words."""
        blocks = np.zeros(len(a), np.int64)
        for k in reversed(range(len(levels))):
            same = levels[k][a + blocks * len(COVER)] == levels[k][b + blocks * len(COVER)]
            blocks += same.astype(np.int64) << k
        return blocks * PERIOD + self.words(self.samples[a] + blocks * PERIOD, self.samples[b] + blocks * PERIOD,
                                            np.full(len(a), PERIOD))

    def words(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words agree from i and j on, `most` at most."""
        equal, open_ = np.zeros(len(i), np.int64), np.flatnonzero(most > 0)
        for t in range(PERIOD):
            open_ = open_[self.numbers[i[open_] + t] == self.numbers[j[open_] + t]]
            equal[open_] = t + 1
            open_ = open_[most[open_] > t + 1]
            if not len(open_):
                break
        return equal

    @staticmethod
    def minima(values: np.ndarray) -> list[np.ndarray]:
        table = [values.astype(np.int32)]
        while 2 << (len(table) - 1) <= len(values):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def lowest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of the common prefixes of the ranks low to high."""
        out = np.empty(len(low), np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            mine = np.flatnonzero(level == k)
            row = self.table[k]
            out[mine] = np.minimum(row[low[mine]], row[high[mine] - (1 << k)])
        return out

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shift = SHIFT[i % PERIOD, j % PERIOD]
        equal = self.words(i, j, shift)
        open_ = np.flatnonzero(equal == shift)
        a, b = i[open_] + shift[open_], j[open_] + shift[open_]
        ranks = [self.rank[p // PERIOD * len(COVER) + PLACE[p % PERIOD]] for p in (a, b)]
        equal[open_] += self.lowest(np.minimum(*ranks), np.maximum(*ranks))
        return equal


def grids(starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, block_pairs: int):
    """Pairs (i, i + q) of equal words of all grids, in blocks: document, i, q."""
    half = sizes // 2
    doc = np.repeat(np.arange(len(sizes)), half)
    period = np.arange(1, len(doc) + 1) - np.repeat(np.cumsum(half) - half, half)
    count = (sizes[doc] - 1) // period
    ends = np.cumsum(count)
    first = 0
    while first < len(doc):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - count[first] + block_pairs, "right")))
        own = slice(first, last)
        at = np.repeat(np.arange(first, last), count[own])
        step = np.arange(len(at)) - np.repeat(ends[own] - count[own] - (ends[first] - count[first]), count[own])
        q = period[at]
        i = starts[doc[at]] + step * q
        same = np.flatnonzero(numbers[i] == numbers[i + q])
        yield doc[at[same]], i[same], q[same]
        first = last


def runs_of(words: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH,
            block_pairs: int = BLOCK_PAIRS) -> tuple[np.ndarray, ...]:
    """document, start, length, period of all runs, in that order; `words` are numbers, documents end to end."""
    separators = words.max(initial=-1) + 1 + np.arange(len(sizes) + 1)
    numbers = np.insert(words.astype(np.int64), np.r_[0, np.cumsum(sizes)], separators)
    starts = np.cumsum(sizes) - sizes + np.arange(1, len(sizes) + 1)
    searched = np.where(sizes >= min_length, sizes, 0)
    found, right, left = [], None, None
    for doc, i, q in grids(starts, searched, numbers, block_pairs):
        if not len(i):
            continue
        if right is None:
            right, left = Extensions(numbers), Extensions(numbers[::-1])
        after = right.of(i, i + q)
        end = len(numbers) - 1
        before = left.of(end - (i - 1), end - (i + q - 1))
        length = before + q + after
        own = np.flatnonzero(length >= np.maximum(min_length, 2 * q))
        found.append(smallest_periods(doc[own], i[own] - before[own] - starts[doc[own]], length[own], q[own]))
    return smallest_periods(*(np.concatenate(x) for x in zip(*found))) if found else (np.zeros(0, np.int64),) * 4


def smallest_periods(doc, start, length, period):
    """Each stretch once, with its smallest period; sorted by document, start, period."""
    order = np.lexsort((period, length, start, doc))
    doc, start, length, period = (x[order] for x in (doc, start, length, period))
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])][:len(doc)]
    doc, start, length, period = (x[new] for x in (doc, start, length, period))
    order = np.lexsort((period, start, doc))
    return tuple(x[order] for x in (doc, start, length, period))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, end to end, and the number of words of each text; nulls have none."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    raw = np.frombuffer(buffer, np.uint8)[offsets[0]:offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    cuts = offsets - offsets[0]
    inside = ~IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a text begins or ends here
    edge[cuts] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
    places = np.r_[0, np.cumsum(ends - starts)]
    words = pa.Array.from_buffers(pa.binary(), len(starts),
                                  [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(raw[inside].tobytes())])
    return words, np.diff(np.searchsorted(starts, cuts))


def slices(batch: pa.RecordBatch, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + slice_bytes, "right")))
        yield batch.slice(first, last - first)
        first = last


def lists(counts: np.ndarray) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(counts)], pa.int32())


def finder(min_length: int, slice_bytes: int, block_pairs: int, names: list[str]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch, slice_bytes):
                words, sizes = split_words(own.column(1).cast(pa.large_binary()))
                numbers = words.dictionary_encode().indices.to_numpy()
                doc, start, length, period = runs_of(numbers, sizes, min_length, block_pairs)
                first = np.cumsum(sizes)[doc] - sizes[doc] + start
                depth = (np.bincount(first + period, minlength=len(words) + 1)
                         - np.bincount(first + length, minlength=len(words) + 1))
                kept = np.cumsum(depth)[:-1] == 0
                left = np.add.reduceat(np.r_[kept, False], np.r_[0, np.cumsum(sizes)[:-1]]) * (sizes > 0)
                text = pa.ListArray.from_arrays(lists(left), words.filter(pa.array(kept)))
                spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)],
                                                   ["start", "length", "period"])
                found = pa.ListArray.from_arrays(lists(np.bincount(doc, minlength=len(sizes))), spans)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array(sizes, pa.int64()), found,
                     pc.binary_join(text, b" ").cast(pa.string())], names)
    return of


def detect(docs: DataFrame, min_length: int = MIN_LENGTH, slice_bytes: int = SLICE_BYTES,
           block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """doc_id, n_words, runs (by start, then period; in words) and collapsed, for each row of `docs` (doc_id, text).

    `collapsed` is the text without what any run has after its first period, words joined by one space.
    """
    schema = StructType([docs.schema["doc_id"], StructField("n_words", LongType()),
                         StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
    return docs.select("doc_id", "text").mapInArrow(
        finder(min_length, slice_bytes, block_pairs, schema.names), schema)
