"""Chunkers: document rows to (document columns, chunk_id, chunk) rows.

Every strategy is an array expression over the text column, exploded with `posexplode`, so
chunking is a narrow stage inside the scan. Greedy packing folds over the piece *sizes* and
remembers only where each chunk starts; the strings are cut out once at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import (BLANK_LINE, Expr, let, literal_split, non_empty, sentences,
                                    strip, words)

# Fixed values.
PACK_CHARS = 1000
PACK_TOKENS = 2000
WINDOW_TOKENS = 512
OVERLAP_CHARS = 2000
OVERLAP = 200
SEPARATORS = ("\n\n", "\n", ".", " ", "")


def raw_paragraphs(text: Column, sep: str = BLANK_LINE) -> Column:
    return literal_split(text, sep)


def clean_paragraphs(text: Column, sep: str = BLANK_LINE) -> Column:
    return non_empty(F.transform(literal_split(text, sep), strip))


def _packed(pieces: Column, cost: Expr, limit: int, joiner: str, empty_head: bool,
            costs: Column | None = None) -> Column:
    """Greedy packing: a piece opens a new chunk when it would take the chunk over `limit`.

    With `empty_head`, a first piece that is over the limit on its own leaves an empty
    chunk before it. `costs` replaces `cost` where the sizes come from a Python function.
    """
    def cut(parts: Column, sizes: Column) -> Column:
        def step(acc: Column, need: Column) -> Column:
            over = acc["used"] + need > limit
            opens = over if empty_head else over & (acc["at"] > 0)
            return F.struct(
                F.when(opens, F.concat(acc["starts"], F.array(acc["at"])))
                .otherwise(acc["starts"]).alias("starts"),
                F.when(over, need).otherwise(acc["used"] + need).alias("used"),
                (acc["at"] + 1).alias("at"),
            )

        zero = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("used"), F.lit(0).alias("at"))
        starts = F.aggregate(sizes, zero, step, lambda acc: acc["starts"])
        return let(starts, lambda st: F.transform(st, lambda s, j: F.array_join(
            F.slice(parts, s + 1, F.coalesce(F.get(st, j + 1), F.size(parts)) - s), joiner)))

    if costs is None:
        packed = let(pieces, lambda parts: cut(parts, F.transform(parts, cost)))
    else:
        packed = let(F.struct(pieces.alias("parts"), costs.alias("sizes")), lambda x: cut(x["parts"], x["sizes"]))
    return F.when(F.size(pieces) > 0, packed).otherwise(F.array().cast("array<string>"))


def packed_paragraphs(text: Column, size: int = PACK_CHARS, sep: str = BLANK_LINE) -> Column:
    """Paragraphs packed up to `size` characters, separators counted, chunks stripped."""
    gap = len(sep)
    return F.transform(
        _packed(literal_split(text, sep), lambda p: F.length(p) + gap, size, sep, False), strip)


def packed_words(text: Column, size: int = PACK_CHARS) -> Column:
    return _packed(words(text), lambda w: F.length(w) + 1, size, " ", True)


def packed_sentences(text: Column, size: int = PACK_CHARS) -> Column:
    return F.transform(
        _packed(sentences(text), lambda s: F.length(s) + 1, size, " ", False), strip)


def packed_tokens(text: Column, size: int = PACK_TOKENS, sep: str = BLANK_LINE,
                  tokenizer: Expr = words, counter: Expr | None = None) -> Column:
    """Paragraphs packed up to `size` tokens; separators are free, nothing is stripped.

    `tokenizer` is a column expression; a Python tokenizer comes in as `counter`, a pandas
    UDF from the array of paragraphs to the array of their token counts.
    """
    pieces = literal_split(text, sep)
    costs = None if counter is None else counter(pieces)
    return _packed(pieces, lambda p: F.size(tokenizer(p)), size, sep, True, costs)


def _groups(pieces: Column, n: int, joiner: str) -> Column:
    """Every n pieces joined; the last group may be short."""
    def cut(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(parts), F.lit(n)),
                           lambda i: F.array_join(F.slice(parts, i, n), joiner))
    return F.when(F.size(pieces) > 0, let(pieces, cut)).otherwise(F.array().cast("array<string>"))


def token_windows(text: Column, size: int = WINDOW_TOKENS, tokenizer: Expr = words,
                  decode: Expr | None = None) -> Column:
    """Fixed token counts without overlap, joined by a space or handed to `decode`."""
    if decode is None:
        return _groups(tokenizer(text), size, " ")

    def cut(toks: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(toks), F.lit(size)),
                           lambda i: decode(F.slice(toks, i, size)))
    toks = tokenizer(text)
    return F.when(F.size(toks) > 0, let(toks, cut)).otherwise(F.array().cast("array<string>"))


def line_groups(text: Column, lines: int) -> Column:
    return _groups(literal_split(text, "\n"), lines, "\n")


def overlapping(text: Column, size: int = OVERLAP_CHARS, overlap: int = OVERLAP) -> Column:
    """Windows of `size` characters, each starting `size - overlap` after the one before,
    up to the one that reaches the end."""
    stride = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / F.lit(float(stride)))).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1),
                       lambda i: F.substring(text, i * stride + 1, F.lit(size)))


def _split_keeping(text: Column, sep: str) -> Column:
    """Non-empty pieces; every separator stays at the head of the piece after it. No separator: characters."""
    if sep == "":
        return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return non_empty(F.transform(literal_split(text, sep), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(sep), p))))


def _windows(sizes: Column, size: int, overlap: int) -> Column:
    """(from, to) ranges of neighbouring pieces of one group that fit `size`, for (length, group) pairs.

    A window begins with the last pieces of the one before it, as many as fit `overlap` and
    leave room for the next piece.
    """
    def carried(acc: Column, need: Column) -> Column:
        last = F.reverse(F.slice(sizes, acc["first"] + 1, acc["at"] - acc["first"]))
        zero = F.struct(F.lit(0).alias("held"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def keep(k: Column, x: Column) -> Column:
            held = k["held"] + x["n"]
            fits = k["open"] & (held <= overlap) & (held + need <= size)
            return F.when(fits, F.struct(held.alias("held"), (k["n"] + 1).alias("n"), F.lit(True).alias("open"))).otherwise(
                F.struct(k["held"].alias("held"), k["n"].alias("n"), F.lit(False).alias("open")))
        return F.aggregate(last, zero, keep)

    def state(out: Column, first: Column, held: Column, at: Column, group: Column) -> Column:
        return F.struct(out.alias("out"), first.alias("first"), held.alias("held"), (at + 1).alias("at"), group.alias("g"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"]
        done = F.concat(acc["out"], F.array(F.struct(acc["first"].alias("a"), at.alias("b"))))
        return (F.when((at > 0) & (x["g"] != acc["g"]), state(done, at, x["n"], at, x["g"]))
                .when((acc["held"] + x["n"] > size) & (at > acc["first"]), let(carried(acc, x["n"]), lambda k: state(
                    done, at - k["n"], k["held"] + x["n"], at, x["g"])))
                .otherwise(state(acc["out"], acc["first"], acc["held"] + x["n"], at, x["g"])))

    zero = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("out"), F.lit(0).alias("first"),
                    F.lit(0).alias("held"), F.lit(0).alias("at"), F.lit("").alias("g"))
    return F.aggregate(sizes, zero, step, lambda acc: F.concat(acc["out"], F.when(acc["at"] > acc["first"], F.array(
        F.struct(acc["first"].alias("a"), acc["at"].alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))))


def separator_aware(text: Column, size: int = OVERLAP_CHARS, overlap: int = OVERLAP, separators=SEPARATORS) -> Column:
    """Overlapping chunks that prefer to break at the coarsest separator.

    Pieces that are too long are split at the next separator, level by level. The pieces of one
    split are joined up to `size`, with up to `overlap` characters carried over; a piece that was
    split further stands apart from its neighbours.
    """
    def splitter(level: int, sep: str) -> Callable[[Column, Column], Column]:
        def split(x: Column, i: Column) -> Column:
            group = F.concat(x["g"], F.lit(f"/{level}:"), i.cast("string"))
            return F.when(F.length(x["p"]) < size, F.array(x)).otherwise(
                F.transform(_split_keeping(x["p"], sep), lambda p: F.struct(p.alias("p"), group.alias("g"))))
        return split

    pieces = F.array(F.struct(text.alias("p"), F.lit("").alias("g")))
    for level, sep in enumerate(separators):
        pieces = F.flatten(F.transform(pieces, splitter(level, sep)))
    pieces = F.filter(pieces, lambda x: x["p"] != "")

    def cut(parts: Column) -> Column:
        sizes = F.transform(parts, lambda x: F.struct(F.length(x["p"]).alias("n"), x["g"].alias("g")))
        ranges = let(sizes, lambda own: _windows(own, size, overlap))
        return non_empty(F.transform(ranges, lambda r: strip(F.array_join(F.transform(
            F.slice(parts, r["a"] + 1, r["b"] - r["a"]), lambda x: x["p"]), ""))))

    whole = non_empty(F.array(strip(text)))  # nothing to split: most texts end here
    return F.when(F.length(text) < size, whole).when(text.isNotNull(), let(pieces, cut))


STRATEGIES: dict[str, Callable[..., Column]] = {
    "paragraph": packed_paragraphs,
    "fixed_char": packed_words,
    "sentence": packed_sentences,
    "token": token_windows,
    "paragraph_raw": raw_paragraphs,
    "paragraph_clean": clean_paragraphs,
    "paragraph_token": packed_tokens,
    "lines": line_groups,
    "overlap": overlapping,
    "separators": separator_aware,
}


def chunks_of(text: Column, strategy: str = "paragraph", **options) -> Column:
    """Array of chunks by the named strategy."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no chunking strategy is named {strategy!r}")
    if strategy == "token" and options.get("tokenizer") is None:
        raise ValueError("strategy 'token' needs a tokenizer")
    return STRATEGIES[strategy](text, **options)


def exploded(df: DataFrame, pieces: Column, *keep: str, out: str = "chunk") -> DataFrame:
    """One row per piece, numbered from 0."""
    return df.select(*keep, F.posexplode(pieces).alias("chunk_id", out))


def chunk(df: DataFrame, strategy: str = "paragraph", keep: tuple[str, ...] = ("doc_id",),
          text: str = "text", **options) -> DataFrame:
    return exploded(df, chunks_of(F.col(text), strategy, **options), *keep)
