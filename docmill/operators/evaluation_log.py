"""A log of evaluation runs, as sketches that can be merged and compared without the chunks.

A run leaves one row per group: counts and sums, a KLL sketch of the scores and an HLL sketch of
the documents. Rows are appended. Sketches of several groups or runs merge, so any two runs, or
spans of runs, can be compared for the cost of reading their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size parameter of the quantile sketch; ranks are off by less than RANK_ERROR with 99 % confidence.
KLL_K = 800
RANK_ERROR = 0.005
#: Binary logarithm of the number of HLL buckets; counts are off by about 1.6 % (one standard deviation).
HLL_K = 12


def log_rows(scored: DataFrame, run: str, group: str | None = None, threshold: float = 0.5) -> DataFrame:
    """(run, group, chunks, total, low, lowest, highest, scores, documents) of rows (doc_id, score); null scores are left out."""
    by = (F.lit("") if group is None else F.coalesce(F.col(group).cast("string"), F.lit(""))).alias("group")
    score = F.col("score").cast("double")
    return scored.where("score IS NOT NULL").groupBy(F.lit(run).alias("run"), by).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(score).alias("total"),
        F.count_if(score < threshold).alias("low"), F.min(score).alias("lowest"), F.max(score).alias("highest"),
        F.kll_sketch_agg_double(score, F.lit(KLL_K)).alias("scores"),
        F.hll_sketch_agg(F.col("doc_id").cast("string"), F.lit(HLL_K)).alias("documents"))


def append_run(scored: DataFrame, path: str, run: str, group: str | None = None, threshold: float = 0.5) -> None:
    """Log a run; logging it again replaces its rows."""
    rows = log_rows(scored, run, group, threshold).drop("run")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/run={run}")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The log's rows; a run without scores has none."""
    return spark.read.schema("group string, chunks long, total double, low long, lowest double, highest double, "
                             "scores binary, documents binary, run string").parquet(path)


def summary(log: DataFrame, *by: str, quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Logged rows merged per `by` (by default per run): counts, mean, share of low scores, quantiles, distinct documents."""
    by = by or ("run",)
    merged = log.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("chunks", "total", "low")], F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
        F.kll_merge_agg_double("scores").alias("scores"), F.hll_union_agg("documents").alias("documents"))
    return merged.select(
        *by, "chunks", (F.col("total") / F.col("chunks")).alias("mean_score"), (F.col("low") / F.col("chunks")).alias("low_share"),
        "lowest", "highest", *[F.kll_sketch_get_quantile_double("scores", F.lit(q)).alias(f"q{round(q * 100)}") for q in quantiles],
        F.hll_sketch_estimate("documents").alias("n_documents"))


def score_drift(log: DataFrame, before: str, after: str, points: int = 20) -> DataFrame:
    """(group, drift): the largest shift of the scores between two runs, over `points` - 1 evenly spaced quantiles.

    Groups that only one run has are left out.
    """
    def own(run: str, name: str) -> DataFrame:
        return log.where(F.col("run") == run).groupBy("group").agg(F.kll_merge_agg_double("scores").alias(name))

    def at(sketch: str, i: int) -> Column:
        return F.kll_sketch_get_quantile_double(sketch, F.lit(i / points))
    shifts = [F.abs(at("was", i) - at("now", i)) for i in range(1, points)]
    return own(before, "was").join(own(after, "now"), "group").select("group", F.array_max(F.array(*shifts)).alias("drift"))
