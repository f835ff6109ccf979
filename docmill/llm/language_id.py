"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a linear classifier on hashed byte n-grams
learns which side of the code a text's language is on. A text gets the language whose codeword
is nearest by loss-weighted decoding: the losses of the bits are weighted by how well each bit's
classifier knew that language in training. Where the two nearest codewords are about as near as
each other, the text is flagged as ambiguous.

The classifiers are fitted on the driver on at most `MAX_TRAINING` documents, as many from each
language, those with the smallest hash of their id. All texts are scored whole, in one narrow
stage without a shuffle.

Defined results: texts that are null or hold no letter are `und` with score 0. Rows without an id,
text or language teach nothing. With one learned language every text with a letter is of that
language; with none it is `und`. Repeated rows are scored each and teach once. Equally near codewords go by
the order of the languages. Empty tables give an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import LOWERED, fold, held_out
from docmill.session import staged

MAX_TRAINING = 3000
MAX_LANGUAGES = 500
HELD_OUT = 1
BUCKETS = 1 << 12
GRAMS = (2, 3, 4)
#: Odd multipliers of the rolling hash and of the last mix.
ROLL, MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)
STEPS, RATE, SHRINK = 150, 0.05, 1e-4
CLOSE = 0.2
UNKNOWN = "und"
#: Byte table: A-Z in lower case, other ASCII that is no letter a space.
LETTERS = bytes(LOWERED[b] if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Square roots of the counts of hashed byte n-grams of a whole text, at unit length."""
    raw = b" %s " % b" ".join(text.lower().encode().translate(LETTERS).split())
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    rolled, counts = data, np.zeros(BUCKETS)
    for n in range(2, max(GRAMS) + 1):
        if len(data) < n:
            break
        rolled = rolled[:-1] * ROLL ^ data[n - 1:]
        if n in GRAMS:
            counts += np.bincount((rolled * MIX) >> np.uint32(20), minlength=BUCKETS)
    length = np.sqrt(counts.sum())
    return (np.sqrt(counts) / (length or 1)).astype(np.float32)


def codewords(languages: int) -> np.ndarray:
    """One row of -1 and 1 per language: all ways to halve a few languages, else well spread random bits."""
    if languages <= 7:
        splits = range(1, 1 << (languages - 1)) if languages > 1 else ()
        return np.array([[1 if s >> i & 1 else -1 for s in splits] for i in range(languages)], np.float32)
    bits = int(np.ceil(10 * np.log2(languages)))
    rng = np.random.default_rng(languages)
    draws = [rng.choice([-1, 1], (languages, bits)).astype(np.float32) for _ in range(20)]

    def nearest(code):
        return -(code @ code.T - 2 * bits * np.eye(languages)).max()
    return max(draws, key=nearest)


class OutputCodes:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def losses(self, x: np.ndarray) -> np.ndarray:
        """How far each text is from each codeword."""
        margins = (x @ self.weights + self.bias)[:, None, :] * self.code[None]
        return (np.logaddexp(0, -margins) * self.trust[None]).sum(axis=2)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        names, scores, doubts = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for at in range(0, len(known), 256):  # a bounded number of dense vectors at a time
            rows = known[at:at + 256]
            nearness = -self.losses(np.stack([grams(texts[i]) for i in rows])).astype(float) * max(1, self.code.shape[1])
            odds = np.exp(nearness - nearness.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            order = np.argsort(-odds, axis=1, kind="stable")
            for row, i in enumerate(rows):
                best = odds[row, order[row, 0]]
                names[i], scores[i] = self.languages[order[row, 0]], float(best)
                doubts[i] = odds.shape[1] > 1 and bool(best - odds[row, order[row, 1]] < CLOSE)
        return names, scores, doubts


def fit(x: np.ndarray, languages: list[str]) -> OutputCodes:
    """Logistic classifiers of all bits at once by full gradient steps, so that fits repeat."""
    names = sorted(set(languages))
    code = codewords(len(names))
    bits = code.shape[1] if code.ndim == 2 else 0
    if not bits:
        return OutputCodes(names, np.zeros((len(names), 0), np.float32), np.zeros((BUCKETS, 0), np.float32),
                           np.zeros(0, np.float32), np.zeros((len(names), 0), np.float32))
    which = np.array([names.index(x) for x in languages])
    side = code[which]
    share = (1 / np.bincount(which)[which] / len(names)).astype(np.float32)[:, None]  # languages count alike
    weights, bias = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    first = [np.zeros_like(weights), np.zeros_like(bias)]
    second = [np.zeros_like(weights), np.zeros_like(bias)]
    for step in range(1, STEPS + 1):
        slope = -side * share / (1 + np.exp(np.clip(side * (x @ weights + bias), -30, 30)))
        for i, (value, gradient) in enumerate(((weights, x.T @ slope + SHRINK * weights), (bias, slope.sum(axis=0)))):
            first[i] = 0.9 * first[i] + 0.1 * gradient
            second[i] = 0.999 * second[i] + 0.001 * gradient ** 2
            value -= RATE * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    right = ((x @ weights + bias) * side > 0).astype(np.float32)
    trust = np.stack([right[which == k].mean(axis=0) for k in range(len(names))]) + 1e-3
    return OutputCodes(names, code, weights, bias, (trust / trust.sum(axis=1, keepdims=True)).astype(np.float32))


def least_hashes(rows: DataFrame, counts: dict[str, int], quota: int) -> DataFrame:
    """Distinct (doc_id, lang) that hold the `quota` least hashes of ids of every language, and not many more.

    A language's share of the hashes is set by its number of rows, to leave four times the quota,
    and widened where rows that repeat their ids leave too few. So the rest is cut off in the scan.
    """
    share = {lang: min(1.0, 4 * quota / n) for lang, n in counts.items()}
    while True:
        limit = F.create_map(*[F.lit(x) for lang, part in share.items()
                               for x in (lang, min((1 << 63) - 1, int(part * 2 ** 64) - (1 << 63)))])
        near = staged(rows.where(F.xxhash64("doc_id") <= limit[F.col("lang")]).select("doc_id", "lang").distinct(), "least-hashes")
        found = {r.lang: r.n for r in near.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
        short = [lang for lang, part in share.items() if part < 1 and found.get(lang, 0) < quota]
        if not short:
            return near
        share.update({lang: min(1.0, 8 * share[lang]) for lang in short})


def train(docs: DataFrame, max_rows: int = MAX_TRAINING, max_languages: int = MAX_LANGUAGES) -> OutputCodes:
    """Fit on at most `max_rows` documents outside the held-out fold, spread evenly over the languages.

    `max_languages` bounds the codes of the model; more languages than that are a ValueError.
    """
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(
        fold(F.col("doc_id")) != HELD_OUT)
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return fit(np.zeros((0, BUCKETS), np.float32), [])
    quota = max(1, max_rows // len(counts))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = least_hashes(rows, counts, quota).withColumn("n", F.row_number().over(order)).where(
        F.col("n") <= quota).select("doc_id", "lang")

    @F.pandas_udf("binary")
    def vector(text: pd.Series) -> pd.Series:
        return pd.Series([grams(t).tobytes() for t in text], dtype=object)
    # at most max_rows pairs of id and language
    found = rows.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).select(
        "doc_id", "lang", vector("text").alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "x").limit(max_rows)
    sample = found.toPandas()
    x = np.frombuffer(b"".join(sample["x"]), np.float32).reshape(-1, BUCKETS)
    return fit(x, sample["lang"].tolist())


def identified(text: Column, model: OutputCodes) -> Column:
    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores, doubts = model.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores, "ambiguous": doubts})
    return of(text)


def identify(docs: DataFrame, max_rows: int = MAX_TRAINING) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: one row per row of `docs` (doc_id, text, lang)."""
    model = train(docs, max_rows)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                       identified(F.col("text"), model).alias("found")).select("doc_id", "held_out", "found.*")
