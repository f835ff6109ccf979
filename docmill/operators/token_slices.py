"""Token windows as exact slices of the text.

A tokenizer tells where in the text each of its tokens begins. A window begins where its first token does and
ends where the next window begins, so what the tokenizer leaves out between tokens stays at the end of a window,
and the windows of a text put together are the text. Nothing is decoded: characters that
take several tokens, spaces and letters that a tokenizer would write otherwise come back as they are.

Defined results: null and empty texts have no windows. A window that would begin within a character of several tokens
begins before it; one that would be empty so is left out. A text without tokens is one window. A task holds the
tokens of one text at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.operators.chunking import WINDOW_TOKENS, exploded

PYTHON_TEXTS = 64
#: Gives the code point at which each token of a text begins, in ascending order.
Starts = Callable[[str], np.ndarray]


def library_starts(vocabulary: str) -> Callable[[], Starts]:
    """Token starts by the `tokenizers` library; `vocabulary` is the content of its JSON file, which goes out with the tasks."""
    def load() -> Starts:
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_str(vocabulary)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda text: np.array([a for a, _ in tokenizer.encode(text, add_special_tokens=False).offsets], np.int64)
    return load


def cuts(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Where the windows of a text begin, and its end."""
    inner = np.maximum.accumulate(starts)[size::size] if len(starts) else starts
    return np.unique(np.r_[0, inner, length])


def token_slices(text: Column, load: Callable[[], Starts], size: int = WINDOW_TOKENS) -> Column:
    """Array of windows of `size` tokens. `load` is called once a task and gives the tokenizer."""
    if size < 1:
        raise ValueError("size must be at least 1")

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        starts = load()

        def windows(t: str | None) -> list[str]:
            at = cuts(starts(t), len(t), size).tolist() if t else [0]
            return [t[a:b] for a, b in zip(at, at[1:])]

        for texts in batches:  # few of a batch's texts are Python strings at a time
            yield pa.concat_arrays([pa.array([windows(t) for t in texts.slice(a, PYTHON_TEXTS).to_pylist()], pa.list_(pa.string()))
                                    for a in range(0, max(1, len(texts)), PYTHON_TEXTS)])

    return cut(text)


def chunk(df: DataFrame, load: Callable[[], Starts], size: int = WINDOW_TOKENS, keep: tuple[str, ...] = ("doc_id",),
          text: str = "text") -> DataFrame:
    """(*keep, chunk_id, chunk): one row per window."""
    return exploded(df, token_slices(F.col(text), load, size), *keep)
