"""Quality rules with a hashed n-gram log-likelihood ratio between trusted texts and the corpus.

Words and pairs of words are hashed to a fixed number of buckets. Counting all documents gives
the raw multinomial, counting the trusted ones (labelled of good quality and not toxic) the
target. A document scores the mean log ratio of target to raw over its n-grams, so its length
does not matter. Documents that fail the base rules, or score below the threshold, are rejected.

The threshold separates the trusted documents from the bad ones (labelled of quality 0 or toxic),
over all labelled rows that pass the base rules. Trusted documents fall into two halves by a hash of
their id, which are counted apart; a labelled row is scored for the threshold with the half it is
not in, so that no score has seen its own text, and all documents are judged with both halves. Of the
edges of fixed bins the threshold is the one with the largest share of bad rows below it less the
share of trusted ones below it, the lowest of equals: the same data give the same threshold in any
order. A trusted row weighs no more than its share, wherever it scores: one among the junk lowers all
edges above it alike, and does not pull the threshold down. Counting adds up a bounded table per
task; the corpus is read once to score, and once to count for every four million trusted ids.

Defined results: null, empty and wordless texts have no words, fail the base rules and score 0.
Rows without an id are counted and scored but never trusted. Repeated rows are counted and
scored each; a document labelled both ways is on neither side. Without trusted documents in both
halves, or without bad ones, the base rules alone decide. Other columns are not looked at. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import SPACES
from docmill.session import staged

BUCKETS = 1 << 16
SMOOTHING = 1.0
BIN = 0.001
#: Trusted ids in a block: 32 MB.
BLOCK_IDS = 4_000_000
MIN_WORDS, MAX_REPEATED = 50, 0.5
SYMBOLS = b"#*$%&|<>"
MIX, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
MEASURES = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "llr double, unseen double")


def word_codes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's words as numbers of its distinct words, and a hash of each of these."""
    number: dict[bytes, int] = {}
    words = raw.split()
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    return codes, np.fromiter(map(crc32, number), np.uint64, len(number))


def buckets(codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The buckets of all words and all pairs of neighbouring words."""
    words = hashes[codes] + np.uint64(1)
    grams = np.concatenate([words, words[:-1] * TURN ^ words[1:]])
    return ((grams * MIX) >> np.uint64(48)).astype(np.int64)


def repeated_words(codes: np.ndarray, distinct: int) -> int:
    """Words in windows of three that the text holds twice or more, the first included."""
    if len(codes) < 4:
        return 0
    pair, base = codes[:-1] * distinct + codes[1:], distinct ** 2
    if distinct ** 3 >= 1 << 62:  # number the pairs that occur, so that a triple fits one integer
        pair, base = np.unique(pair, return_inverse=True)[1], len(codes)
    triples = pair[:-1] + base * codes[2:]
    _, which, count = np.unique(triples, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count[which] > 1)
    covered = np.zeros(len(codes), bool)
    for shift in range(3):
        covered[often + shift] = True
    return int(covered.sum())


def measures(text: str | None, codes: np.ndarray, distinct: int, raw: bytes) -> tuple[int, int, int, int, int]:
    lines = [line for line in raw.split(b"\n") if line.strip()]
    spaces = len(raw) - len(raw.translate(None, SPACES.encode()))
    return (len(codes), len(text or "") - spaces, len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(codes, distinct))


def counter(trusted, first: bool):
    """Bucket counts of a task's rows (doc_id, half, text): one row per bucket, whatever the number of texts.

    `trusted` holds sorted ids; the counts of all rows are left to the `first` block of them.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, BUCKETS), np.int64)  # all rows, the trusted of half 0, those of half 1
        known = np.append(trusted.value, np.iinfo(np.int64).max)
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            among = (known[np.searchsorted(known[:-1], ids)] == ids) & (np.searchsorted(known[:-1], ids) < len(known) - 1)
            among &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            halves = np.where(among, batch.column(1).to_numpy(), -1).tolist()
            for text, half in zip(batch.column(2), halves):
                if not first and half < 0:
                    continue
                found = np.bincount(buckets(*word_codes((text.as_py() or "").encode())), minlength=BUCKETS)
                if first:
                    counts[0] += found
                if half >= 0:
                    counts[1 + half] += found
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(c[at]) for c in counts]], ["bucket", "raw", "half0", "half1"])
    return of


def scorer(ratios: np.ndarray, halves: tuple[np.ndarray, np.ndarray]):
    """Measures of rows (doc_id, text, half): `llr` by `ratios`, `unseen` by those of the half the row is not in."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, half in zip(batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py()
                raw = (text or "").encode()
                codes, hashes = word_codes(raw)
                found = buckets(codes, hashes)
                scores = [float(r[found].sum() / len(found)) if len(found) else 0.0 for r in (ratios, halves[1 - half])]
                rows.append((*measures(text, codes, len(hashes), raw), *scores))
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:5]],
                 *[pa.array(c, pa.float64()) for c in columns[5:]]],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "unseen"])
    return of


def half_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(2))


def sides(labels: DataFrame) -> DataFrame:
    """doc_id, trusted: documents that all their labels call good and none toxic, or all call of quality 0 or toxic."""
    quality, toxic = F.coalesce("quality", F.lit(-1)), F.coalesce("toxic", F.lit(0))
    good, bad = (quality == 1) & (toxic == 0), (quality == 0) | (toxic == 1)
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(good).alias("trusted"), F.min(bad).alias("bad")).where("trusted OR bad").select("doc_id", "trusted")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id, half (0 or 1): the trusted documents."""
    return sides(labels).where("trusted").select("doc_id", half_of(F.col("doc_id")).alias("half"))


def bucket_counts(docs: DataFrame, trusted: DataFrame, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """Counts of the n-grams of all documents, of the trusted ones of half 0 and of those of half 1, per bucket.

    Texts do not move to meet the trusted ids: these go to the tasks, in blocks of about `block_ids`
    of eight bytes each, one narrow pass over the documents a block.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select("doc_id", half_of(F.col("doc_id")).alias("half"), "text")
    ids = trusted.select("doc_id").distinct()
    blocks = max(1, -(-ids.count() // block_ids))
    out = np.zeros((3, BUCKETS))
    names = ["raw", "half0", "half1"]
    for block in range(blocks):
        own = ids.where(F.pmod(F.xxhash64(F.lit(block_ids), "doc_id"), F.lit(blocks)) == block).toArrow()
        shared = context.broadcast(np.sort(own["doc_id"].to_numpy().astype(np.int64)))
        counts = rows.mapInArrow(counter(shared, block == 0), "bucket long, raw long, half0 long, half1 long").groupBy(
            "bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # at most BUCKETS rows
        out[:, counts["bucket"]] += counts[names].to_numpy().T
    return out


def ratios_of(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Per bucket the log of target to raw probability."""
    return (np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS))
            - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)))


def log_ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray | None:
    """The ratios of half 0 alone to the counts of all documents."""
    raw, target, _ = bucket_counts(docs, trusted)
    return ratios_of(target, raw) if target.sum() else None


def best_edge(bins: list[tuple[int, int, int]]) -> float:
    """The lower edge to keep from, of bins (number, trusted rows, bad rows) in their order."""
    n_trusted, n_bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    best, edge, lost, caught = 0, -np.inf, 0, 0
    for number, trusted, bad in bins:
        lost, caught = lost + trusted, caught + bad
        if caught * n_trusted - lost * n_bad > best:  # shares over one denominator, exact in integers
            best, edge = caught * n_trusted - lost * n_bad, (number + 1) * BIN
    return edge


def threshold(scores: DataFrame, sided: DataFrame) -> float:
    """The edge that best parts the labelled rows that pass the base rules, by scores that have not seen them."""
    bins = scores.join(sided, "doc_id").where("NOT base_failed").groupBy(
        F.floor(F.col("unseen") / BIN).alias("bin")).agg(
        F.count_if("trusted").alias("trusted"), F.count_if(~F.col("trusted")).alias("bad")).orderBy("bin")
    return best_edge([tuple(b) for b in bins.collect()])  # scores of a bounded range in bins of one width


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the measures, llr, base_failed, kept: one row per row of `docs` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.withColumn("doc_id", F.col("doc_id").cast("long"))
    trusted = staged(trusted_ids(labels), "trusted")
    raw, *targets = bucket_counts(docs, trusted)
    both = sum(targets)
    ratios = ratios_of(both, raw) if both.any() else np.zeros(BUCKETS)
    halves = tuple(ratios_of(t, raw) for t in targets)
    scores = docs.withColumn("half", half_of(F.col("doc_id"))).mapInArrow(scorer(ratios, halves), MEASURES)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words"))
    scores = scores.withColumn("base_failed", failed)
    least = -np.inf
    if all(t.any() for t in targets):
        scores = staged(scores, "scores")
        least = threshold(scores, sides(labels))
    return scores.drop("unseen").withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(float(least))))
