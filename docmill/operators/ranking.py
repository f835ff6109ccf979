"""Ordinals, top_k / top_p and last-n, safe for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.operators.topk import ranked
from docmill.session import checkpointed, staged

LAST_MESSAGES = 20
ONE_TASK_ROWS = 100_000  # as many first rows one task may sort; more are numbered by ranges


def ordinals(df: DataFrame, group: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """Exact 1-based position within a group, also when one group holds most of the table.

    A plain window would sort a whole group in one task. Here the rows are range-partitioned
    on (group, order), fixed by a checkpoint, numbered inside each partition, and shifted by
    the rows the same group has in earlier partitions. Only groups that cross a partition
    border need a shift, so the shift table has at most one row per partition. Null is a group
    like any other.
    """
    keys = [*group, *order]
    placed = checkpointed(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                          .withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"))
    by_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_before", F.sum("_n").over(earlier)).where("_before is not null").select(
        F.col("_part").alias("_at_part"), *[F.col(c).alias(f"_at_{c}") for c in group], "_before")
    local = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))
    same = F.col("_part") == F.col("_at_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_at_{c}"))
    return (placed.withColumn("_at", local).join(F.broadcast(shifts), same, "left")
            .withColumn(out, (F.col("_at") + F.coalesce("_before", F.lit(0))).cast("bigint"))
            .drop("_part", "_at", "_before", "_at_part", *[f"_at_{c}" for c in group]))


def appended(conversations: DataFrame, messages: DataFrame, session: str = "session_id", seq: str = "seq",
             order: str = "ts") -> DataFrame:
    """New messages with sequence numbers that go on from what their session already holds.

    The last number of a session is one row per session and task; only new messages are
    sorted, whatever the size of the stored table.
    """
    last = conversations.groupBy(session).agg(F.max(seq).alias("_last")).withColumnRenamed(session, "_session")
    numbered = ordinals(messages, [session], [order], seq)
    return numbered.join(last, F.col(session).eqNullSafe(F.col("_session")), "left").withColumn(
        seq, F.col(seq) + F.coalesce("_last", F.lit(0))).drop("_last", "_session")


def limited(hits: DataFrame, order: list[str], top_k: int | None = 5, top_p: float | None = None,
            group: str | None = None, matched: str | None = None) -> DataFrame:
    """First top_p share (at least one), then first top_k, of each group; 0 and None mean no limit.

    `matched` names a column that adds up to the number of all hits of a group, for hits that
    hold no more than the first top_k of a group. Without it the given rows are counted, so
    they are staged: they are ranked as well, and are computed once.
    """
    if not top_k and not top_p:
        return hits
    count = F.count(F.lit(1)) if matched is None else F.sum(matched)
    if top_p:
        hits = staged(hits, "hits")
    if top_k and group is not None:
        kept = ranked(hits, group, [F.col(c) for c in order], top_k)
    elif top_k and top_k <= ONE_TASK_ROWS:
        kept = hits.orderBy(*order).limit(top_k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    else:
        kept = ordinals(hits, [group] if group else [], order)
        kept = kept.where(F.col("rank") <= top_k) if top_k else kept
    if not top_p:
        return kept

    def share(n: Column) -> Column:
        return F.greatest(F.floor(n * F.lit(float(top_p))), F.lit(1))

    if group is None:
        return kept.where(F.col("rank") <= share(hits.agg(count).scalar()))
    total = hits.groupBy(F.col(group).alias("_group")).agg(count.alias("_n"))
    return kept.join(total, F.col(group).eqNullSafe(F.col("_group"))).where(
        F.col("rank") <= share(F.col("_n"))).drop("_n", "_group")


def last_messages(conversations: DataFrame, n: int = LAST_MESSAGES, session: str = "session_id",
                  seq: str = "seq") -> DataFrame:
    """The last n messages of each session; `position` counts them oldest first."""
    if n < 1:
        raise ValueError("n must be at least 1")
    last = ranked(conversations, session, [F.col(seq).desc()], n)
    oldest_first = Window.partitionBy(session).orderBy(seq)
    return last.drop("rank").withColumn("position", F.row_number().over(oldest_first))
