"""Packing by Karmarkar-Karp multiway differencing.

A document's ids are cut into pieces. Whole windows of `capacity` ids are sequences by
themselves; the rest of a document is cut by halves into a few pieces of unlike sizes. The pieces
of a block of documents are then parted into k windows: every piece starts as a partition of k
window loads, the two partitions with the largest spread are merged with their loads in opposite
order, heavy on light, until one partition is left. k starts at the least number that can hold
the block and rises by one whenever a window exceeds the capacity.

A block is `BLOCK_WINDOWS` windows' worth of rests, taken in the order of the rows of a
partition, so nothing is shuffled and a task holds one block at a time. A partition that is
computed again after a loss gives the same sequences. Sequence ids carry the partition's number
in their upper bits, so they are unique.

Defined results: a null or empty text is the end id alone. Rows without an id and rows that share
an id are packed each. Texts of any length are encoded whole; one with 100,000 white space characters
in a row by the `tokenizers` library itself, with the same ids. Windows whose length is a power of
two need no padding. Other columns are not looked at. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

CAPACITY = 1024
BLOCK_WINDOWS = 96
#: Rests are halved until a piece has at most this many ids.
SMALLEST_CUT = 16
END_ID = 0
PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


#: White space in a row that the pattern of `tiktoken` may not be able to walk back through.
LONG_BLANK = re.compile(r"(?:\A|\S)\s{100000}")


def checked(spec: str) -> dict:
    """The parsed file, if `tiktoken` gives its ids; ValueError for any other kind of vocabulary."""
    model = json.loads(spec)
    before = model.get("pre_tokenizer") or {}
    vocabulary = model["model"].get("vocab", {})
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"].get("merges", [])]
    made = [vocabulary.get("".join(pair), -1) for pair in pairs]
    if not (model["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and model.get("normalizer") is None
            and made == sorted(made) and min(made, default=0) >= 0
            and not any(t.get(k) for t in model["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))):
        raise ValueError("not a byte-level BPE with split words, without prefix space and normalizer, merged in the order of ids")
    return model


class ByteLevel:
    """The byte-level BPE of a `tokenizers` JSON file, run by the faster `tiktoken` where that can."""

    def __init__(self, spec: str):
        self.fast, self.spec, self.whole = byte_level_encoding(spec), spec, None

    def ids(self, text: str) -> np.ndarray:
        if len(text) > 100_000 and LONG_BLANK.search(text):
            self.whole = self.whole or Tokenizer.from_str(self.spec)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")


def byte_level_encoding(spec: str) -> tiktoken.Encoding:
    """The byte-level BPE of a `tokenizers` JSON file as a `tiktoken` encoding.

    Ids equal those of the `tokenizers` library with add_special_tokens=False (tested): ranks of
    this kind of vocabulary are its ids, and added tokens are found in the raw text first.
    """
    model = checked(spec)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in model["model"]["vocab"].items()
             if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def rest_sizes(length: int) -> list[int]:
    """Cut a rest by halves, down to pieces of at most SMALLEST_CUT ids."""
    out = []
    while length > SMALLEST_CUT:
        out.append(length - length // 2)
        length //= 2
    return [*out, length] if length else out


def differenced(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: part `sizes` into k windows of near-equal sums; lists of indices.

    A partition is kept as its non-empty windows, heaviest first; the other windows are empty.
    """
    heap = []
    for i, size in enumerate(sizes):
        heapq.heappush(heap, (-size, i, [(size, [i])]))
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # the heaviest windows of one partition take the lightest of the other
        overlap = len(a) + len(b) - k
        if overlap <= 0:
            merged = a + b
        else:
            kept = len(a) - overlap
            joined = [(x + y, [*p, *q]) for (x, p), (y, q) in zip(a[kept:], reversed(b[len(b) - overlap:]))]
            merged = a[:kept] + b[:len(b) - overlap] + joined
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, tie, merged))
        tie += 1
    return [members for _, members in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The fewest near-equal windows found that hold all pieces; indices into `sizes`."""
    k = -(-sum(sizes) // capacity)
    while True:
        parts = differenced(sizes, k)
        if all(sum(sizes[i] for i in part) <= capacity for part in parts):
            return parts
        k += 1


def packer(spec: str, capacity: int, block_windows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = ByteLevel(spec)
        end = np.array([END_ID], "<u4")
        next_id = TaskContext.get().partitionId() << 33
        rests, filled, out, held = [], 0, [], 0

        def packed():
            nonlocal next_id
            for part in windows([len(r[2]) // 4 for r in rests], capacity):
                at = 0
                for i in sorted(part):
                    doc, start, ids, total = rests[i]
                    out.append((doc, start, len(ids) // 4, ids, total, next_id, at))
                    at += len(ids) // 4
                next_id += 1

        def flush():
            columns = zip(*out) if out else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encoding.ids(text.as_py() or ""), end])
                whole = len(ids) - len(ids) % capacity
                for start in range(0, whole, capacity):
                    out.append((doc, start, capacity, ids[start:start + capacity].tobytes(), len(ids), next_id, 0))
                    next_id += 1
                start = whole
                for size in rest_sizes(len(ids) - whole):
                    rests.append((doc, start, ids[start:start + size].tobytes(), len(ids)))
                    start += size
                filled += len(ids) - whole
                held += len(ids)
                if filled >= block_windows * capacity:
                    packed()
                    rests, filled = [], 0
                if held >= 1 << 20:
                    yield flush()
                    out, held = [], 0
        packed()
        if out:
            yield flush()
    return of


def pack(docs: DataFrame, spec: str, capacity: int = CAPACITY, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Pieces of all rows of `docs` (doc_id, text), with their ids as little-endian 32-bit numbers.

    `spec` is the content of a byte-level BPE file of the `tokenizers` library.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(packer(spec, capacity, block_windows), PIECES)
