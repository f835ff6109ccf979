"""Edit-aware token counts with a segment tree per document.

A byte-level BPE splits a text into pre-tokens and encodes each by itself, so a count is a sum
over any parts that are cut between pre-tokens. A document's leaves are such parts of about
`LEAF_CHARS` characters; a segment tree holds the sums of their characters and tokens. An edit
finds its leaves by descending the tree, takes in a neighbour where it touches the characters
that make a cut safe, encodes only that region again and updates the sums above it.

Cuts are safe before a space that stands between a character that is no white space and a letter:
a pre-token may start with one space but never holds one behind other characters, so such a
space always starts a pre-token, whatever stands around these three characters. Added tokens of the
vocabulary, as '<|endoftext|>', are found in the raw text first and count one each, as in packing. One
that holds such a space itself never lies across a cut: places within it are not cut, and an edit
takes in every neighbour whose cut it is so near to that it could make one there.

Defined results: null and empty texts have no tokens and a null text stays null unless an edit
inserts something. Edits are (start, stop, text) in code points of the text before any edit; they
may not overlap, and may come in any order; null edits, and a null list, change nothing; a null
replacement is empty; places outside the text are an error. Repeated rows are counted each. Other
columns are not looked at. Empty tables give an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.packing import ByteLevel

LEAF_CHARS = 256
SLICE_ROWS = 256
SAFE = re.compile(r"\S [^\W\d_]")
EDITS = "array<struct<start:long,stop:long,text:string>>"
Edit = tuple[int, int, str]


def leaves(text: str, size: int = LEAF_CHARS, added: Sequence[str] = ()) -> list[str]:
    """Parts of a text that are cut at safe places outside of `added` tokens, the first one after every `size` characters."""
    out, start, at = [], 0, size - 1
    while found := SAFE.search(text, at):
        cut = at = found.start() + 1
        if any(t in text[max(0, cut - len(t) + 1):cut + len(t) - 1] for t in added):
            continue
        out.append(text[start:cut])
        start, at = cut, cut + size - 1
    if start < len(text):
        out.append(text[start:])
    return out


class SegmentTree:
    """Sums of characters and tokens over a document's leaves; node 1 is the root, i has children 2i and 2i + 1.

    `added` are the added tokens that hold a place to cut (`breakable`).
    """

    def __init__(self, parts: list[str], count: Callable[[str], int], tokens: list[int] | None = None,
                 added: Sequence[str] = ()):
        self.parts, self.count, self.added = list(parts), count, added
        self.longest = max(map(len, added), default=0)
        self.width = 1 << max(0, len(parts) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, part in enumerate(parts):
            self.chars[self.width + i] = len(part)
            self.tokens[self.width + i] = tokens[i] if tokens is not None else count(part)
        for i in reversed(range(1, self.width)):
            self._sum(i)
        self.encoded = 0

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and the place of the leaf's first one; the last leaf for the text's end."""
        node, start = 1, 0
        if place >= self.chars[1]:
            last = max(0, len(self.parts) - 1)
            return last, self.chars[1] - self.chars[self.width + last]
        while node < self.width:
            node *= 2
            if place - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def replace(self, start: int, stop: int, text: str) -> None:
        """Put `text` in place of the characters from start to stop and count what is around it again."""
        if not 0 <= start <= stop <= self.chars[1]:
            raise ValueError(f"edit {start}:{stop} outside a text of {self.chars[1]} characters")
        if not self.parts:
            self.__init__(leaves(text, added=self.added), self.count, added=self.added)
            self.encoded = len(text)
            return
        first, at = self.leaf_at(start)
        while first and start < at + max(2, self.longest):  # the cut before this leaf may no longer be safe
            first -= 1
            at -= len(self.parts[first])
        last, end = first, at + len(self.parts[first])
        while last + 1 < len(self.parts) and stop > end - max(1, self.longest):  # nor the one behind it
            last += 1
            end += len(self.parts[last])
        region = "".join(self.parts[first:last + 1])
        region = region[:start - at] + text + region[stop - at:]
        fresh = leaves(region, added=self.added)
        room = last + 1 - first
        if len(fresh) > room:  # the tree keeps its shape: the last leaf takes what is left
            fresh[room - 1:] = ["".join(fresh[room - 1:])]
        fresh += [""] * (room - len(fresh))
        for i, part in enumerate(fresh, first):
            self.parts[i] = part
            self.chars[self.width + i], self.tokens[self.width + i] = len(part), self.count(part)
        self.encoded += len(region)
        low, high = (self.width + first) // 2, (self.width + last) // 2
        while low:
            for i in range(low, high + 1):
                self._sum(i)
            low, high = low // 2, high // 2

    def edit(self, edits: list[Edit]) -> None:
        """Apply edits of the text as it is now, the last place first, so that earlier places stay as they are."""
        ordered = sorted(edits, key=lambda e: (e[0], e[1]))
        for (_, stop, _), (start, _, _) in zip(ordered, ordered[1:]):
            if start < stop:
                raise ValueError(f"edits overlap at {start}")
        for start, stop, text in reversed(ordered):
            self.replace(start, stop, text)

    @property
    def text(self) -> str:
        return "".join(self.parts)


def counter(spec: str) -> Callable[[str], int]:
    encoding = ByteLevel(spec)
    return lambda text: len(encoding.ids(text))


def breakable(spec: str) -> list[str]:
    """The added tokens that can hold a place to cut: a space behind another character, the letter may be the text's."""
    return [t["content"] for t in json.loads(spec)["added_tokens"] if re.search(r"\S ", t["content"])]


def trees(text: Column, spec: str) -> Column:
    """Struct of leaf_chars and leaf_tokens (arrays) and n_tokens: what `SegmentTree` takes to go on another day."""
    @F.pandas_udf("leaf_chars array<int>, leaf_tokens array<int>, n_tokens long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count, added = counter(spec), breakable(spec)
        for texts in batches:
            rows = []
            for whole in texts:
                parts = leaves(whole or "", added=added)
                tokens = [count(p) for p in parts]
                rows.append(([len(p) for p in parts], tokens, sum(tokens)))
            yield pd.DataFrame(rows, columns=["leaf_chars", "leaf_tokens", "n_tokens"])
    return of(text)


def recounter(spec: str, edits_of: Callable[[str | None], list[Edit]] | None, schema: pa.Schema):
    """Builds the tree of every row (doc_id, text, edits), applies its edits and counts again."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, added = counter(spec), breakable(spec)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):  # a few texts at a time as Python objects
                rows = []
                part = batch.slice(at, SLICE_ROWS)
                given = part.column(2).to_pylist() if edits_of is None else [None] * part.num_rows
                for text, change in zip(part.column(1).to_pylist(), given):
                    change = [(e["start"], e["stop"], e["text"] or "") for e in change or ()] if edits_of is None else edits_of(text)
                    tree = SegmentTree(leaves(text or "", added=added), count, added=added)
                    before, n = tree.tokens[1], len(tree.parts)
                    if change:
                        tree.edit(change)
                        text = tree.text
                    rows.append((before, tree.tokens[1], len(change), n, tree.encoded, text))
                columns = [part.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows), [*schema][1:]))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
    return of


def count_edited(docs: DataFrame, edits: Column | Callable[[str | None], list[Edit]], spec: str) -> DataFrame:
    """doc_id, n_tokens, n_tokens_after, n_edits, n_leaves, chars_encoded (again), edited_text: a row per row of `docs`.

    `edits` is a column of edits, or a function from a text to its edits.
    """
    fixed = isinstance(edits, Column)
    known = F.filter(edits.cast(EDITS), lambda e: e["start"].isNotNull() & e["stop"].isNotNull()) if fixed else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", known.cast(EDITS).alias("edits"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_tokens_after", pa.int64()),
                        ("n_edits", pa.int64()), ("n_leaves", pa.int64()), ("chars_encoded", pa.int64()),
                        ("edited_text", pa.string())])
    return rows.mapInArrow(recounter(spec, None if fixed else edits, schema),
                           "doc_id long, n_tokens long, n_tokens_after long, n_edits long, n_leaves long, "
                           "chars_encoded long, edited_text string")


#: What a clean-up takes out: addresses, numbers of seven digits or more, and long hexadecimal keys.
PRIVATE = re.compile(r"(?P<mail>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)|(?P<key>\b[0-9a-f]{32,}\b)|(?P<number>\+?\d[\d ().-]{5,}\d)")


def cleaning_edits(text: str | None) -> list[Edit]:
    """Edits that mask private data and take out lines that repeat an earlier line of the text."""
    out, seen, at = [], set(), 0
    for line in (text or "").split("\n"):
        if line.strip() and line in seen:
            out.append((at - 1, at + len(line), ""))  # with the line break before it
        else:
            out += [(at + m.start(), at + m.end(), f"<{m.lastgroup}>") for m in PRIVATE.finditer(line)]
        seen.add(line)
        at += len(line) + 1
    return out
