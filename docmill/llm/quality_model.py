"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few dozen numbers. Training bins every feature by quantiles, then boosts
cyclically: round after round, feature by feature, a shallow tree over the feature's bins moves
that feature's lookup table. The pairs of features that explain most of what is left get tables
of their own, grown by trees of four quadrants. A score is the logistic of the sum of table
entries, added up for whole batches at a time.

The model is fitted on the driver on at most `MAX_TRAINING` labelled rows, those with the
smallest hash of their id. All rows are scored, in one narrow stage without a shuffle.

Defined results: a null text counts as empty; an empty text has all features zero and is scored
like any other. Labels that are null or neither 0 nor 1 teach nothing, as do rows without an id.
Repeated rows are scored each; a document labelled twice teaches twice. With no labelled rows
the score is 0.5, with one class only it is near that class; a score of 0.5 counts as label 1. Splits of
equal gain go by the first bin. Empty tables give an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import fold, held_out

MAX_TRAINING = 20_000
HELD_OUT = 1
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 40, 6
RATE, SHRINK, DEPTH, MIN_ROWS = 0.15, 1.0, 2, 10

#: Groups of ASCII bytes whose shares are features.
GROUPS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".", "comma": b",;:",
          "shout": b"!?", "symbol": b"#*$%&|<>=+^~_{}[]\\/@", "quote": b"\"'()", "newline": b"\n"}
FEATURES = [*GROUPS, "beyond_ascii", "n_words", "word_length", "long_words", "distinct_words", "top_word",
            "next_word_same", "distinct_triples", "n_lines", "repeated_lines", "line_ends", "capital_words",
            "letter_words", "byte_entropy", "sentence_length"]


def features(text: str | None) -> list[float]:
    """Numbers that describe a whole text, in the order of FEATURES."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total, n = len(raw), len(words)
    share = counts / total
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    often = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    triples = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    lines = [line for line in raw.split(b"\n") if line.strip()]
    ended = sum(line.rstrip()[-1:] in b".!?" for line in lines)
    capital = sum(count for word, count in often.items() if word[:1].isupper())
    letters = sum(count for word, count in often.items() if word.strip(b".,;:!?").isalpha() or word[0] > 127)
    return [
        *[float(share[list(group)].sum()) for group in GROUPS.values()],
        float(share[128:].sum()), float(np.log1p(n)), float(sizes.mean()), float((sizes > 12).mean()),
        len(often) / n ** 0.8, often.most_common(1)[0][1] / n, same, triples,
        float(np.log1p(len(lines))), 1 - len(set(lines)) / len(lines), ended / len(lines), capital / n,
        letters / n, entropy, float(np.log1p(n / (1 + counts[ord(".")]))),
    ]


def feature_columns():
    @F.pandas_udf("array<double>")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in text], dtype=object)
    return of


class AdditiveModel:
    """Lookup tables per feature and per pair of features."""

    def __init__(self, bias: float):
        self.bias = bias
        self.single: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.double: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, edges, values in self.single:
            total += values[np.searchsorted(edges, x[:, j])]
        for i, j, a, b, values in self.double:
            total += values[np.searchsorted(a, x[:, i]), np.searchsorted(b, x[:, j])]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges at quantiles; equal values share a bin."""
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower"))


def tree(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """A shallow regression tree over the ordered bins of one feature, as one value per bin."""
    g, h, n = np.cumsum(gradient), np.cumsum(weight), np.cumsum(rows)
    best = g[-1] ** 2 / (h[-1] + SHRINK)
    if depth and len(g) > 1:
        gain = g[:-1] ** 2 / (h[:-1] + SHRINK) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + SHRINK)
        gain = np.where((n[:-1] >= MIN_ROWS) & (n[-1] - n[:-1] >= MIN_ROWS), gain, -np.inf)
        at = int(np.argmax(gain)) + 1
        if gain[at - 1] > best + 1e-9:
            return np.concatenate([tree(gradient[:at], weight[:at], rows[:at], depth - 1),
                                   tree(gradient[at:], weight[at:], rows[at:], depth - 1)])
    return np.full(len(g), g[-1] / (h[-1] + SHRINK))


def quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a two-way table into four quadrants: its gain over no cut, one value per cell."""
    g, h = (np.cumsum(np.cumsum(x, axis=0), axis=1) for x in (gradient, weight))

    def parts(c):
        low, left, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        return low, left - low, all_ - low, c[-1, -1] - left - all_ + low
    leaves = [a / (b + SHRINK) for a, b in zip(parts(g), parts(h))]
    gain = sum(a * v for a, v in zip(parts(g), leaves))
    if not gain.size:
        return 0.0, np.zeros_like(gradient)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(gradient)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = (v[i, j] for v in leaves)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting on the logistic loss; the order of rounds and features is fixed, so fits repeat."""
    if not len(y):
        return AdditiveModel(0.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    total = np.full(len(y), model.bias)
    edges = [cuts(x[:, j], BINS) for j in range(x.shape[1])]
    codes = [np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)]
    rows = [np.bincount(c, minlength=len(e) + 1) for c, e in zip(codes, edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]

    def slope():
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)
    for _ in range(ROUNDS):
        for j, code in enumerate(codes):
            g, h = slope()
            step = RATE * tree(np.bincount(code, g, len(tables[j])), np.bincount(code, h, len(tables[j])), rows[j])
            tables[j] += step
            total += step[code]
    model.single = [(j, e, t) for j, (e, t) in enumerate(zip(edges, tables))]

    coarse = [cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    codes = [np.searchsorted(e, x[:, j]) for j, e in enumerate(coarse)]

    def grid(i, j, values):
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(codes[i] * shape[1] + codes[j], values, shape[0] * shape[1]).reshape(shape)
    g, h = slope()
    gains = [(quadrants(grid(i, j, g), grid(i, j, h))[0], i, j)
             for i in range(len(coarse)) for j in range(i + 1, len(coarse))]
    chosen = [(i, j) for _, i, j in sorted(gains, key=lambda t: (-t[0], t[1], t[2]))[:PAIRS]]
    double = {pair: np.zeros((len(coarse[pair[0]]) + 1, len(coarse[pair[1]]) + 1)) for pair in chosen}
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:
            g, h = slope()
            step = RATE * quadrants(grid(i, j, g), grid(i, j, h))[1]
            double[i, j] += step
            total += step[codes[i], codes[j]]
    model.double = [(i, j, coarse[i], coarse[j], t) for (i, j), t in double.items()]
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING) -> AdditiveModel:
    """Fit on at most `max_rows` labelled rows outside the held-out fold, by the hash of their id."""
    marked = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(fold(F.col("doc_id")) != HELD_OUT)
    chosen = marked.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(
        F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows pairs of numbers
    rows = texts.select("doc_id", "quality", feature_columns()("text").alias("x")).orderBy(
        F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(max_rows).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["quality"].to_numpy(float))


def scored(text: Column, model: AdditiveModel) -> Column:
    """The score of a whole text, 0 to 1; higher: label 1 is likelier."""
    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))
            yield pd.Series(model.score(x))
    return of(text)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of `docs` (doc_id, text)."""
    model = train(docs, labels, max_rows)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def apply(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING) -> DataFrame:
    """The rows of `docs` that the classifier does not reject."""
    model = train(docs, labels, max_rows)
    return docs.where(scored(F.col("text"), model) >= 0.5)
