"""Vector retrieval: exact, inverted lists, access filter, diversity re-rank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import let
from docmill.functions.vectors import cosine
from docmill.operators.topk import BLOCK_BYTES, BLOCK_ROWS, MATRIX_CELLS, Kernel, best_rows, blocks_of, first_k, scored, top_k
from docmill.session import staged

# Fixed values.
TOP_K = 5
NLIST = 128
PER_LIST = 256
NLIST_LARGE = 1024
NPROBE = 10
MMR_K = 5
MMR_POOL = 20
MMR_LAMBDA = 0.5


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as a float64 matrix; vectors must share one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if column.null_count or len(flat) % len(column):
        raise ValueError("vectors must not be null and must share one dimension")
    return flat.reshape(len(column), -1)


def squared_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All pairs by one matrix product: fast, but off by up to `distance_slack`."""
    d = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2.0 * (q @ x.T)
    return np.maximum(d, 0.0)


def distance_slack(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A bound on the rounding of `squared_distances` and of the exact sum together."""
    size = np.sqrt((q * q).sum(1))[:, None] + np.sqrt((x * x).sum(1))[None, :]
    return 3.0 * (q.shape[1] + 4) * np.finfo(np.float64).eps * size * size


def exact_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row the sum of squared differences, added up from the first dimension to the last."""
    out = np.zeros(len(q))
    for i in range(q.shape[1]):
        out += (q[:, i] - x[:, i]) ** 2
    return out


def l2_kernel(embedding: str = "embedding") -> Kernel:
    """Squared L2; a row without a vector matches nothing."""
    def filled(of, empty: float):
        def cost(q: np.ndarray, rows: pa.Table) -> np.ndarray:
            has = rows[embedding].is_valid().to_numpy()
            if has.all():
                return of(q, matrix(rows[embedding]))
            out = np.full((len(q), rows.num_rows), empty)
            if has.any():
                out[:, has] = of(q, matrix(rows[embedding].filter(pa.array(has))))
            return out
        return cost

    def exact(q: np.ndarray, rows: pa.Table, i: np.ndarray, c: np.ndarray) -> np.ndarray:
        if not len(i):
            return np.zeros(0)
        used, at = np.unique(c, return_inverse=True)
        x, out = matrix(rows[embedding].take(pa.array(used))), np.empty(len(i))
        step = max(1, MATRIX_CELLS // max(1, q.shape[1]))
        for a in range(0, len(i), step):  # a search without a limit has all pairs here
            out[a:a + step] = exact_distances(q[i[a:a + step]], x[at[a:a + step]])
        return out

    return Kernel(prepare=lambda block: matrix(block[embedding]), cost=filled(squared_distances, np.nan),
                  slack=filled(distance_slack, 0.0), exact=exact)


def vector_top_k(corpus: DataFrame, queries: DataFrame, k: int = TOP_K, *, id_col: str = "vec_id",
                 acl: str | None = None, mode: str = "post", carry: tuple[str, ...] = (),
                 **options) -> DataFrame:
    """Nearest vectors by squared L2, closest first: (qid, id, *carry, distance, rank).

    A query without a vector has no hits, and a row without one is no hit.
    `carry` names columns to keep, which saves a join back to the corpus. `acl` filters the k
    hits afterwards (mode 'post', may leave fewer than k) or the corpus before ('pre').
    """
    if mode not in ("post", "pre"):
        raise ValueError(f"Unsupported acl mode: {mode}")
    post = acl is not None and mode == "post"
    kept = (*carry, "acl") if post and "acl" not in carry else carry
    if acl is not None and mode == "pre":
        corpus = corpus.where(F.col("acl") == acl)
    asked = queries.where("embedding IS NOT NULL")
    hits = top_k(_columns(corpus, id_col, kept, options), asked, l2_kernel(), k, id_col=id_col, carry=kept, **options)
    if post:
        hits = hits.where(F.col("acl") == acl)
    return hits.select("qid", id_col, *carry, F.col("cost").alias("distance"), "rank")


def vector_distances(corpus: DataFrame, queries: DataFrame, *, id_col: str = "vec_id",
                     carry: tuple[str, ...] = (), **options) -> DataFrame:
    """Every vector with its distance to every query, unranked: (qid, id, *carry, distance).

    A query without a vector has no hits, and a row without one is no hit.
    """
    asked = queries.where("embedding IS NOT NULL")
    hits = scored(_columns(corpus, id_col, carry, options), asked, l2_kernel(), None, id_col=id_col, carry=carry, **options)
    return hits.select("qid", id_col, *carry, F.col("cost").alias("distance"))


def _columns(corpus: DataFrame, id_col: str, carry: tuple[str, ...], options: dict) -> DataFrame:
    cell = options.get("cell")
    return corpus.select(*dict.fromkeys([id_col, "embedding", *carry, *([cell] if cell else [])]))


# ---- inverted lists -------------------------------------------------------------------


def train_lists(vectors: DataFrame, nlist: int = NLIST, seed: int = 7, rounds: int = 20,
                per_list: int = PER_LIST) -> DataFrame:
    """k-means centroids: (list_id, embedding). At most `nlist` rows come to the driver.

    They are trained on all vectors, or on about `per_list` for every list where there are more: a
    random sample, written once, so that the rounds do not read the corpus again. Rows without a
    vector teach nothing.
    """
    spark = vectors.sparkSession
    vectors = vectors.where("embedding IS NOT NULL")
    share = nlist * per_list / max(1, vectors.count())
    if share < 1:
        vectors = staged(vectors.select("embedding").sample(False, share, seed), "training-vectors")
    model = KMeans(k=nlist, seed=seed, maxIter=rounds, featuresCol="features").fit(
        vectors.select(array_to_vector("embedding").alias("features")))
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "list_id int, embedding array<double>")


def spread(sizes: np.ndarray, distinct: np.ndarray, nlist: int) -> np.ndarray:
    """Lists per cell: one each, the others by size; a cell gets no more than it has distinct vectors."""
    lists = np.minimum(1, distinct)
    while lists.sum() < min(nlist, distinct.sum()):
        open_cells = np.flatnonzero(lists < distinct)
        # the cell with the most rows a list is served next, ties to the smaller number
        lists[open_cells[np.argmax(sizes[open_cells] / (lists[open_cells] + 1))]] += 1
    return lists


def lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """`k` centroids of the rows of `x`, which hold at least `k` distinct ones; no list stays empty.

    Starts from rows drawn with odds by their squared distance to those drawn before. Lists that
    lose all their rows start again at distinct rows that are farthest from their own centroids.
    """
    rng = np.random.default_rng(seed)
    near = np.full(len(x), np.inf)
    picks = [int(rng.integers(len(x)))]
    while len(picks) < k:
        near = np.minimum(near, exact_distances(np.broadcast_to(x[picks[-1]], x.shape), x))
        picks.append(int(rng.choice(len(x), p=near / near.sum())))
    centroids = x[picks]
    for _ in range(rounds):
        blocks = [squared_distances(x[at:at + 4096], centroids) for at in range(0, len(x), 4096)]
        own = np.concatenate([b.argmin(axis=1) for b in blocks])
        apart = np.concatenate([b.min(axis=1) for b in blocks])
        rows = np.bincount(own, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        moved = np.where(rows[:, None] > 0, sums / np.maximum(rows, 1)[:, None], centroids)
        if (rows == 0).any():
            far = x[apart.argsort(kind="stable")[::-1]]
            other = np.sort(np.unique(far, axis=0, return_index=True)[1])
            moved[rows == 0] = far[other[:int((rows == 0).sum())]]
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


def hash_sample(vectors: DataFrame, rows: int, id_col: str, seed: int) -> DataFrame:
    """About `rows` of the rows that have a vector, by the hash of the id: the same ones however the data are dealt."""
    share = min(1.0, rows / max(1, vectors.count()))  # counts rows without reading vectors
    bound = F.lit(int(share * (1 << 53)))
    return vectors.where("embedding IS NOT NULL").where(
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), 11) < bound).select(
        F.col("embedding").cast("array<double>").alias("embedding"))


def train_two_levels(vectors: DataFrame, nlist: int = NLIST_LARGE, seed: int = 7, rounds: int = 20,
                     per_list: int = PER_LIST, id_col: str = "vec_id") -> DataFrame:
    """Centroids of many lists: (list_id, embedding), list_id from 0, at most `nlist` rows.

    A sample of about `nlist * per_list` vectors is taken in one pass over the corpus and written.
    It is parted into about sqrt(nlist) cells by k-means; each cell is then trained on its own, in a
    task of its own, with as many lists as its share of the sample. So a round compares a vector with
    some sqrt(nlist) centroids, not with all. A task holds one cell, at most the sample. Of fewer
    distinct vectors than lists each gets one list. Rows without a vector teach nothing; without
    any vector there are no lists.
    """
    spark = vectors.sparkSession
    sample = staged(hash_sample(vectors, nlist * per_list, id_col, seed), "training-vectors")
    if sample.isEmpty():
        return spark.createDataFrame([], "list_id int, embedding array<double>")
    cells = assign_lists(sample, train_lists(sample, max(1, round(nlist ** 0.5)), seed, rounds, per_list=nlist * per_list))
    cells = staged(cells.select(F.col("list_id").alias("cell"), "embedding"), "training-cells")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("embedding").alias("distinct")).orderBy(
        "cell").toPandas()  # about sqrt(nlist) rows
    lists = spread(sizes["n"].to_numpy(), sizes["distinct"].to_numpy(), nlist)
    first = np.cumsum(lists) - lists
    plan = {int(c): (int(f), int(n)) for c, f, n in zip(sizes["cell"], first, lists)}

    def train(table: pa.Table) -> pa.Table:
        start, n = plan[table["cell"][0].as_py()]
        x = matrix(table["embedding"])
        x = x[np.lexsort(x.T[::-1])]  # the same start whatever the order of the rows
        centroids = lloyd(x, n, rounds, seed)
        return pa.table({"list_id": pa.array(start + np.arange(n), pa.int32()),
                         "embedding": pa.array(list(centroids), pa.list_(pa.float64()))})

    return staged(cells.groupBy("cell").applyInArrow(train, "list_id int, embedding array<double>"), "centroids")


def _nearer(vectors: DataFrame, centroids: pa.Table, n: int) -> DataFrame:
    """`lists` with the n nearest of the lists held so far and of one more block of centroids."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf("array<struct<distance:double,list_id:int>>")
    def nearest(embedding: pa.Array, lists: pa.Array) -> pa.Array:
        step = max(1, MATRIX_CELLS // n)  # with many lists a vector, few vectors at a time
        return pa.concat_arrays([some(embedding.slice(a, step), lists.slice(a, step))
                                 for a in range(0, max(1, len(embedding)), step)])

    def some(embedding: pa.Array, lists: pa.Array) -> pa.Array:
        has = np.flatnonzero(embedding.is_valid().to_numpy(zero_copy_only=False))
        asked = pa.table({"embedding": embedding.take(pa.array(has))})
        held = lists.take(pa.array(has))
        flat = held.flatten()
        earlier = pa.table({"q": np.repeat(np.arange(len(has)), held.value_lengths().to_numpy(zero_copy_only=False)),
                            "cost": flat.field("distance"), "list_id": flat.field("list_id")})
        near = [earlier]
        if len(has):  # the vectors are the queries of the kernel, the centroids its corpus
            near += [t.select(["q", "cost", "list_id"]) for t in best_rows(
                l2_kernel(), asked, iter([shared.value]), "list_id", [], n)]
        best = first_k(pa.concat_tables(near, promote_options="permissive"), ["cost", "list_id"], n)
        sizes = np.zeros(len(embedding), np.int32)
        sizes[has] = np.bincount(best["q"].to_numpy(), minlength=len(has))
        items = pa.StructArray.from_arrays(
            [best["cost"].combine_chunks().cast(pa.float64()), best["list_id"].combine_chunks().cast(pa.int32())],
            names=["distance", "list_id"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), items)

    return vectors.withColumn("lists", nearest("embedding", "lists"))


def with_lists(vectors: DataFrame, centroids: DataFrame, n: int = 1, block_rows: int = 32 * BLOCK_ROWS,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add `lists`, the n nearest centroids, ties to the smaller list: array of (distance, list_id).

    Centroids come in blocks; the vectors are never shuffled, and written once between two
    blocks. A row without a vector has no lists.
    """
    rows = vectors.withColumn("lists", F.array().cast("array<struct<distance:double,list_id:int>>"))
    lists = centroids.select("list_id", F.col("embedding").cast("array<double>").alias("embedding"))
    for i, block in enumerate(blocks_of(lists, "list_id", block_rows, block_bytes)):
        rows = _nearer(staged(rows, "lists") if i else rows, block, n)
    return rows


def assign_lists(vectors: DataFrame, centroids: DataFrame, **options) -> DataFrame:
    """Each vector with its list: the layout to write `partitionBy('list_id')`."""
    near = F.get(F.col("lists"), F.lit(0))
    return (with_lists(vectors, centroids, 1, **options)
            .withColumn("list_id", near["list_id"]).withColumn("list_distance", near["distance"])
            .drop("lists"))


def probe_top_k(assigned: DataFrame, centroids: DataFrame, queries: DataFrame, k: int = TOP_K,
                nprobe: int = NPROBE, id_col: str = "vec_id", **options) -> DataFrame:
    """Search only the `nprobe` lists nearest to each query; exact inside them."""
    probing = with_lists(queries, centroids, nprobe).withColumn(
        "probes", F.transform("lists", lambda x: x["list_id"])).drop("lists")
    return vector_top_k(assigned, probing, k, id_col=id_col, cell="list_id", probes="probes", **options)


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Share of the exact hits that were found: one row (hits, matched, recall)."""
    both = exact.select("qid", id_col).join(
        found.select("qid", id_col).withColumn("ok", F.lit(1)), ["qid", id_col], "left")
    return both.agg(F.count(F.lit(1)).alias("hits"), F.count("ok").alias("matched")).withColumn(
        "recall", F.round(F.col("matched") / F.col("hits"), 6))


def recall_by_nprobe(assigned: DataFrame, centroids: DataFrame, queries: DataFrame, k: int = TOP_K,
                     id_col: str = "vec_id", **options) -> DataFrame:
    """(nprobe, hits, matched, recall) for every number of lists at which the recall grows.

    An exact hit is found if its list is among those probed, so one exact search that carries the
    list of each hit tells the recall of all numbers of probes at once.
    """
    nlist = max(1, centroids.count())
    near = with_lists(queries, centroids, nlist).select("qid", F.transform("lists", lambda x: x["list_id"]).alias("order"))
    hits = vector_top_k(assigned, queries, k, id_col=id_col, carry=("list_id",), **options)
    needed = hits.join(near, "qid").select(F.array_position("order", F.col("list_id")).cast("int").alias("nprobe"))
    counts = needed.groupBy("nprobe").agg(F.count(F.lit(1)).alias("n"))  # a row a list at most
    upto = Window.orderBy("nprobe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select("nprobe", F.sum("n").over(Window.partitionBy()).alias("hits"), F.sum("n").over(upto).alias("matched")
                         ).withColumn("recall", F.round(F.col("matched") / F.col("hits"), 6))


def nprobe_for(measured: DataFrame, least: float = 0.9) -> int | None:
    """The smallest number of probes whose measured recall is at least `least`; None if nothing was asked."""
    return measured.where(F.col("recall") >= least).agg(F.min("nprobe")).first()[0]


# ---- diversity ------------------------------------------------------------------------


def mmr_top_k(corpus: DataFrame, queries: DataFrame, k: int = MMR_K, pool: int = MMR_POOL,
              weight: float = MMR_LAMBDA, id_col: str = "vec_id") -> DataFrame:
    """Maximal marginal relevance (Carbonell & Goldstein 1998) over the `pool` nearest vectors.

    A step takes the candidate with the largest weight * cos(query) - (1 - weight) * (largest
    cosine to those taken), ties to the nearer candidate. The pool bounds every array. The hits
    carry their vectors out of the search, so the corpus is read once.
    """
    hits = vector_top_k(corpus, queries, pool, id_col=id_col, carry=("embedding",))
    found = hits.join(queries.select("qid", F.col("embedding").alias("_query")), "qid")
    cands = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(
        "rank", F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("v"),
        cosine(F.col("_query"), F.col("embedding")).alias("sim")))).alias("cands"))

    def picks(c: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            scored = F.transform(c, lambda x, i: F.struct(
                F.array_contains(acc["taken"], i).alias("used"),
                (-(weight * x["sim"] - (1 - weight) * F.get(acc["near"], i))).alias("order"),
                i.alias("i")))
            return let(F.array_min(scored), lambda best: F.when(best["used"], acc).otherwise(F.struct(
                F.concat(acc["taken"], F.array(best["i"])).alias("taken"),
                F.concat(acc["scores"], F.array(-best["order"])).alias("scores"),
                let(F.get(c, best["i"])["v"], lambda chosen: F.zip_with(
                    c, acc["near"], lambda x, near: F.when(
                        F.size(acc["taken"]) == 0, cosine(x["v"], chosen)).otherwise(
                        F.greatest(near, cosine(x["v"], chosen))))).alias("near"))))

        zero = F.struct(F.array().cast("array<int>").alias("taken"),
                        F.array().cast("array<double>").alias("scores"),
                        F.transform(c, lambda _: F.lit(0.0)).alias("near"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(k)), zero, step, lambda acc: F.zip_with(
            acc["taken"], acc["scores"], lambda i, s: F.struct(F.get(c, i)["id"].alias("id"), s.alias("score"))))

    chosen = cands.select("qid", F.posexplode(let(F.col("cands"), picks)).alias("at", "pick"))
    return chosen.select("qid", F.col("pick.id").alias(id_col), F.col("pick.score").alias("score"),
                         (F.col("at") + 1).alias("rank"))
