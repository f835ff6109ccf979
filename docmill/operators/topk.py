"""The best k corpus rows of every query, without ever pairing corpus and query rows up.

Queries are staged once and handled in blocks of a bounded size. A block is broadcast, and every
task streams its corpus splits through the kernel, holding k rows per query; only those leave
the task. More blocks mean more passes over the corpus, which itself is never copied, grouped
or shuffled. One small shuffle on the query id merges the partial lists.

Costs are compared as they are. A kernel may score by a fast formula if it states how far that
can be off; all rows within that distance of the k-th best are then scored exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from docmill.session import staged

BLOCK_ROWS = 2048
BLOCK_BYTES = 64 << 20
MATRIX_CELLS = 1_000_000
PLAN_BLOCKS = 16  # passes of one plan; the partial lists of more are written and read again


@dataclass(frozen=True)
class Kernel:
    """`prepare` turns a query block into state; `cost` scores corpus rows against it.

    `cost` returns one row per query and one column per corpus row, lower is better, NaN for
    no match. With `exact`, these costs are off by at most `slack`, and `exact` gives the costs
    of (query, row) pairs, the same for equal rows wherever they stand. `width` is the size of
    the state's widest matrix side, to bound the batches.
    """

    prepare: Callable[[pa.Table], Any]
    cost: Callable[[Any, pa.Table], np.ndarray]
    width: Callable[[Any], int] = lambda state: 1
    slack: Callable[[Any, pa.Table], np.ndarray] | None = None
    exact: Callable[[Any, pa.Table, np.ndarray, np.ndarray], np.ndarray] | None = None


def first_k(rows: pa.Table, order: list[str], k: int) -> pa.Table:
    """The first k rows of each `q` in the given order."""
    by = [("q", "ascending"), *[(c, "ascending") for c in order]]
    rows = rows.take(pc.sort_indices(rows, sort_keys=by))
    q = rows["q"].to_numpy()
    begin = np.searchsorted(q, q, side="left")
    return rows.filter(pa.array(np.arange(len(q)) - begin < k))


def _pairs(kernel: Kernel, state: Any, piece: pa.Table, worst: np.ndarray, k: int | None):
    """(query, row, exact cost) of the rows of a piece that can be among the k best."""
    cost = kernel.cost(state, piece)
    slack = 0.0 if kernel.slack is None else kernel.slack(state, piece)
    limit = worst
    if k is not None and piece.num_rows > k:
        limit = np.fmin(worst, np.partition(cost + slack, k - 1, axis=1)[:, k - 1])
    q, c = np.nonzero(cost - slack <= limit[:, None])
    return q, c, cost[q, c] if kernel.exact is None else kernel.exact(state, piece, q, c)


def best_rows(kernel: Kernel, block: pa.Table, parts: Iterator[pa.Table], id_col: str, carry: list[str],
              k: int | None) -> Iterator[pa.Table]:
    """The k best rows per query (q: its place in the block) of a stream of corpus rows; all rows without k."""
    state = kernel.prepare(block)
    nq = block.num_rows
    step = max(1, MATRIX_CELLS // max(nq, kernel.width(state)))
    worst = np.full(nq, np.inf)
    held: pa.Table | None = None
    for part in parts:
        for at in range(0, part.num_rows, step):
            piece = part.slice(at, step)
            q, c, cost = _pairs(kernel, state, piece, worst, k)
            if not len(q):
                continue
            found = piece.select([id_col, *carry]).take(pa.array(c))
            found = found.append_column("q", pa.array(q)).append_column("cost", pa.array(cost))
            if k is None:
                yield found
                continue
            held = first_k(found if held is None else pa.concat_tables([held, found]), ["cost", id_col], k)
            hq, hc = held["q"].to_numpy(), held["cost"].to_numpy()
            full = np.bincount(hq, minlength=nq) == k
            last = np.full(nq, np.inf)
            last[hq] = hc  # rows are sorted, so the last write per query is its worst cost
            worst = np.where(full, last, np.inf)
    if held is not None:
        yield held


def blocks_of(df: DataFrame, key: str, rows: int = BLOCK_ROWS, limit_bytes: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """A table in blocks of about `rows` rows and `limit_bytes` bytes, one of them at a time on the driver.

    It is measured before anything is collected; a table of several blocks is staged, so that its
    rows are not computed again for every block.
    """
    weight = F.coalesce(F.length(F.to_json(F.struct(*df.columns))), F.lit(0))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    count = max(1, -(-n // rows), -(-size // limit_bytes))
    df = staged(df, "blocks") if count > 1 else df
    for block in range(count):
        own = df if count == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(count)) == block)
        yield own.toArrow()


def passes(results: Iterator[DataFrame], label: str) -> DataFrame:
    """The union of the results of all blocks, whose number does not make the plan grow without bound."""
    done: list[DataFrame] = []
    for result in results:
        if len(done) == PLAN_BLOCKS:
            done = [staged(reduce(DataFrame.unionByName, done), label)]
        done.append(result)
    return reduce(DataFrame.unionByName, done)


def _schema(corpus: DataFrame, queries: DataFrame, qid: str, id_col: str, carry: list[str]) -> T.StructType:
    kept = [corpus.schema[c] for c in [id_col, *carry]]
    return T.StructType([T.StructField(qid, queries.schema[qid].dataType),
                         *[T.StructField(f.name, f.dataType) for f in kept],
                         T.StructField("cost", T.DoubleType())])


def ranked(hits: DataFrame, qid: str, order: list[Column], k: int) -> DataFrame:
    """Rank within a query and keep k; Spark limits each group before the shuffle."""
    w = Window.partitionBy(qid).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scored(corpus: DataFrame, queries: DataFrame, kernel: Kernel, k: int | None, *, qid: str = "qid",
           id_col: str = "doc_id", carry: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS,
           block_bytes: int = BLOCK_BYTES, cell: str | None = None, probes: str | None = None) -> DataFrame:
    """(qid, id, *carry, cost): at least the k cheapest corpus rows per query, all matching rows without k."""
    schema = _schema(corpus, queries, qid, id_col, list(carry))
    context = corpus.sparkSession.sparkContext

    def one(table: pa.Table) -> DataFrame:
        rows = corpus
        if cell is not None:  # lists that no query of the block probes are not read
            wanted = {v for vs in table[probes].to_pylist() for v in vs}
            rows = corpus.where(F.col(cell).isin(sorted(wanted)))
        return rows.mapInArrow(_search(context.broadcast(table), kernel, k, qid, id_col, list(carry),
                                       schema.names, cell, probes), schema)

    return passes((one(t) for t in blocks_of(queries, qid, block_rows, block_bytes)), "partial")


def top_k(corpus: DataFrame, queries: DataFrame, kernel: Kernel, k: int, *, qid: str = "qid",
          id_col: str = "doc_id", **options) -> DataFrame:
    """(qid, id, *carry, cost, rank) of the k cheapest corpus rows per query, ties by id.

    `cell` names a corpus column that restricts the search: a row is a candidate only for
    queries whose array column `probes` holds its value.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    hits = scored(corpus, queries, kernel, k, qid=qid, id_col=id_col, **options)
    return ranked(hits, qid, [F.col("cost"), F.col(id_col)], k)


def _search(block, kernel, k, qid, id_col, carry, names, cell, probes):
    masked = kernel if cell is None else _within_cells(kernel, cell, probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not block.value.num_rows:
            return
        parts = (pa.Table.from_batches([b]) for b in batches)
        for best in best_rows(masked, block.value, parts, id_col, carry, k):
            yield from best.append_column(qid, block.value[qid].take(best["q"])).select(names).to_batches()

    return run


def _within_cells(kernel: Kernel, cell: str, probes: str) -> Kernel:
    """Score only rows of the cells a query probes."""
    def prepare(block: pa.Table):
        asked: dict[Any, list[int]] = {}
        for q, values in enumerate(block[probes].to_pylist()):
            for v in values:
                asked.setdefault(v, []).append(q)
        by_cell = {v: (np.array(qs), kernel.prepare(block.take(pa.array(qs)))) for v, qs in asked.items()}
        return block.num_rows, by_cell

    def each(state, rows: pa.Table):
        values = rows[cell].to_numpy()
        for v in np.unique(values):
            if v in state[1]:
                qs, inner = state[1][v]
                at = np.flatnonzero(values == v)
                yield qs, at, inner, rows.take(pa.array(at))

    def filled(of: Callable, empty: float):
        def matrix(state, rows: pa.Table) -> np.ndarray:
            out = np.full((state[0], rows.num_rows), empty)
            for qs, at, inner, own in each(state, rows):
                out[np.ix_(qs, at)] = of(inner, own)
            return out
        return matrix

    def exact(state, rows: pa.Table, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.full(len(q), np.nan)
        for qs, at, inner, own in each(state, rows):
            mine = np.flatnonzero(np.isin(c, at))
            out[mine] = kernel.exact(inner, own, np.searchsorted(qs, q[mine]), np.searchsorted(at, c[mine]))
        return out

    def width(state) -> int:
        return max((kernel.width(inner) for _, inner in state[1].values()), default=1)

    return Kernel(prepare, filled(kernel.cost, np.nan), width,
                  None if kernel.slack is None else filled(kernel.slack, 0.0),
                  None if kernel.exact is None else exact)
