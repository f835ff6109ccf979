"""SimHash near-dedup by a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight positional bytes. Two fingerprints that differ in at most
`max_bits` bits share at least `8 - max_bits` of them, the guaranteed minimum of matches. The
inverted index maps positional bytes to fingerprints. A posting of a single byte would hold
1/256 of the corpus, so a posting is keyed by three bytes at once: of any five shared positions
three lie in the same half of the fingerprint, hence the eight triples within the halves reach
every pair. For pairs that meet in a posting the shared positional bytes are tallied; pairs that
reach the minimum are kept, and the bit distance verifies them.

A posting of more than `MAX_POSTING` fingerprints is never brought together: its rows move to
the ten postings that add two of the other five positions (every pair with five matches meets
in one of them). Such a posting leaves three free bytes, so it holds at most 2**24 fingerprints.
Fingerprints are compared once per value, whatever the number of their copies, and a posting
returns a spanning forest of its links rather than all of them. Components come from repeated
star contraction over the links between fingerprints.

Defined results: a null or wordless text has fingerprint zero, linked like any other. Rows
without an id have a fingerprint and a null component and link nothing. Rows that share an id are
compared as rows, each by its own text; `apply` keeps one row of each component, so rows of one id in
several components are all kept. Other columns are not looked at, but to choose among rows of the
same id and text; `apply` carries them along whatever their names are. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import LOWERED, whole_rows
from docmill.session import staged

SHINGLE = 3
MAX_BITS = 3
SEED = 42
MAX_POSTING = 4096
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Hashes whose bits are added up at a time, so that a long text needs bounded memory.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text: a bit is one if it is one in over half of the shingles' XXH64."""
    words = (text or "").encode().translate(LOWERED).split()  # bytes split at \x20 and \x09-\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    last = ends[min(shingle, len(words)) - 1:].tolist()
    first = (ends - sizes)[:len(last)].tolist()
    of = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(last), BLOCK):
        block = [of(joined[a:b], SEED) for a, b in zip(first[at:at + BLOCK], last[at:at + BLOCK])]
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(last), bitorder="little").view("<i8")[0])


def fingerprints(shingle: int = SHINGLE):
    @F.pandas_udf("long")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in text], dtype="int64")
    return of


def links_within(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links among distinct fingerprints.

    The next unvisited fingerprint is compared with all unvisited ones at a time, so memory
    stays in proportion to the posting.
    """
    least, out = 8 - max_bits, []
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            xor = fps[left] ^ fps[at]
            shared = (xor.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = shared >= least
            near[near] = np.bitwise_count(xor[near]) <= max_bits
            found = left[near]
            out += [(int(at), int(x)) for x in found]
            queue += found.tolist()
            left = left[~near]
    return out


def posting_links(max_bits: int):
    """Links of rows (posting, detail, fp) that come sorted by posting and detail."""
    least = 8 - max_bits

    def pairs(keys: np.ndarray, fps: np.ndarray) -> tuple[list, list]:
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(fps)])
        a, b = [], []
        small = np.repeat(sizes <= 16, sizes)
        for step in range(1, int(min(16, sizes.max()))):  # postings of a few fingerprints, all at once
            i = np.flatnonzero(small[:-step] & (keys[step:] == keys[:-step]).all(axis=1))
            xor = fps[i] ^ fps[i + step]
            i = i[(xor.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= least]
            i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= max_bits]
            a += fps[i].tolist()
            b += fps[i + step].tolist()
        for start, size in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist()):
            own = fps[start:start + size]
            for x, y in links_within(own, max_bits):
                a.append(int(own[x]))
                b.append(int(own[y]))
        return a, b

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for rows in batches:
            keys = np.stack([rows.column(0).to_numpy(), rows.column(1).to_numpy()], axis=1)
            keys = np.concatenate([held_keys, keys])
            fps = np.concatenate([held, rows.column(2).to_numpy().view(np.uint64)])
            if not len(fps):
                continue
            # the last posting may go on in the next batch
            cut = int(np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])[-1])
            held_keys, held = keys[cut:], fps[cut:]
            if cut:
                yield batch_of(*pairs(keys[:cut], fps[:cut]))
        if len(held):
            yield batch_of(*pairs(held_keys, held))

    def batch_of(a: list, b: list) -> pa.RecordBatch:
        ends = [np.array(x, np.uint64).view(np.int64) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])
    return of


def byte_at(position: int):
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))


def keyed(positions: tuple[int, ...]):
    """The positional bytes as one number."""
    key = byte_at(positions[0])
    for p in positions[1:]:
        key = F.shiftleft(key, 8).bitwiseOR(byte_at(p))
    return key


def close_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, max_posting: int = MAX_POSTING) -> DataFrame:
    """a, b: links that connect all fingerprints (distinct longs `fp`) at most `max_bits` (0 to 3) apart."""
    if not 0 <= max_bits <= 3:
        raise ValueError("eight positional bytes guarantee five matches only up to three differing bits")
    postings = F.array(*[F.struct(F.lit(i).cast("long").alias("n"), keyed(t).alias("bytes"))
                         for i, t in enumerate(TRIPLES)])
    index = fps.select("fp", F.explode(postings).alias("p")).select(
        "fp", (F.col("p.n") * F.lit(1 << 24) + F.col("p.bytes")).alias("posting"))
    sizes = index.groupBy("posting").agg(F.count("*").alias("n"))
    index = staged(index.join(sizes.where("n > 1"), "posting"), "postings")
    small = index.where(F.col("n") <= max_posting).select("posting", F.lit(0).cast("long").alias("detail"), "fp")
    # no five shared positions are lost: three are in the triple, two of the others make the detail
    details = F.lit(None)
    for i, triple in reversed(list(enumerate(TRIPLES))):
        rest = [*combinations([p for p in range(8) if p not in triple], 2)]
        details = F.when(F.floor(F.col("posting") / (1 << 24)) == i, F.array(*[
            F.lit((n + 1) << 16) + keyed(pair) for n, pair in enumerate(rest)])).otherwise(details)
    large = index.where(F.col("n") > max_posting).select("posting", F.explode(details).alias("detail"), "fp")
    rows = small.unionByName(large).repartition("posting", "detail").sortWithinPartitions("posting", "detail", "fp")
    return rows.select("posting", "detail", "fp").mapInArrow(posting_links(max_bits), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: for every node of `links` (longs a, b) the smallest node of its component.

    Alternating large and small stars: each round hangs nodes onto smaller neighbours, until the
    links are stars. Rounds grow with the logarithm of a component's size; links are staged
    each round, and only their number and sum come to the driver.
    """
    ends = F.when(F.col("a") != F.col("b"), F.array(F.least("a", "b"), F.greatest("a", "b")))
    edges = staged(links.select(ends.alias("e")).where("e IS NOT NULL")
                   .select(F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi")).distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            return edges.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root")
        before = now
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        edges = staged(star(both, F.col("v") > F.col("u")), "stars")
        edges = staged(star(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")), F.lit(True)), "stars")


def star(neighbours: DataFrame, moved) -> DataFrame:
    """Link the `moved` neighbours v of every u, and u itself, to the smallest of u and its neighbours."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = neighbours.where(moved).join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
    own = least.select(F.col("m").alias("lo"), F.col("u").alias("hi"))
    return hung.unionByName(own).where("lo <> hi").distinct()


def grouped(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
            max_posting: int = MAX_POSTING) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp of every row, and fp, first_doc, root of every fingerprint: its smallest id and its component's fingerprint."""
    marked = staged(docs.select("doc_id", fingerprints(shingle)("text").alias("fp")), "fingerprints")
    first = staged(marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "classes")
    nodes = components(close_fingerprints(first.select("fp"), max_bits, max_posting))
    rooted = first.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return marked, rooted


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    max_posting: int = MAX_POSTING) -> DataFrame:
    """doc_id, fp (long), component_id (smallest doc_id reachable): one row per row of `docs` (doc_id, text)."""
    marked, rooted = grouped(docs, shingle, max_bits, max_posting)
    smallest = rooted.groupBy("root").agg(F.min("first_doc").alias("component"))
    found = rooted.join(smallest, "root").select("fp", "component")
    return marked.join(found, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def apply(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component: of the smallest id, then of the smallest fingerprint, then the first by text and the
    other columns; rows without an id all stay."""
    marked, rooted = grouped(docs, shingle, max_bits)
    kept = staged(rooted.groupBy("root").agg(F.min(F.struct(F.col("first_doc").alias("doc_id"), "fp")).alias("least"))
                  .select("least.*"), "kept")
    ids = marked.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    repeated = staged(ids.where("n > 1").select("doc_id"), "repeated")
    whole = whole_rows(docs)
    single = whole.join(kept.select("doc_id").join(repeated, "doc_id", "left_anti"), "doc_id", "left_semi")
    # an id alone does not name one of several rows: these are found by their fingerprints
    rows = whole.join(repeated, "doc_id", "left_semi").withColumn("fp", fingerprints(shingle)("text"))
    rows = rows.join(kept, ["doc_id", "fp"], "left_semi")
    others = [F.col("row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    first = rows.groupBy("doc_id", "fp").agg(F.min_by("row", F.struct("text", *others)).alias("row"))
    left = single.select("row").unionByName(first.select("row")).unionByName(whole.where("doc_id IS NULL").select("row"))
    return left.select("row.*")
