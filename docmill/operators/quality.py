"""Content gate, votes, scores and their reports."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.records import summary_score
from docmill.operators.filters import MIN_CHARS

# Fixed value.
THRESHOLD = 0.5


def judge_rows(docs: DataFrame, judges: dict[str, Column], id_col: str = "doc_id") -> DataFrame:
    """One row per (document, judge); a judge that fails or does not know says no."""
    votes = F.array(*[F.struct(F.lit(name).alias("judge"), F.coalesce(vote, F.lit(False)).alias("vote"))
                      for name, vote in judges.items()])
    return docs.select(id_col, F.explode(votes).alias("v")).select(id_col, "v.*")


def majority(votes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, votes, checks, flagged): flagged when more than half of the checks say yes."""
    yes = F.sum(F.when(F.col("vote"), 1).otherwise(0))
    return votes.groupBy(id_col).agg(yes.alias("votes"), F.count(F.lit(1)).alias("checks")).withColumn(
        "flagged", F.col("votes") > F.col("checks") / 2)


def flagged_by(judges: list[Column]) -> Column:
    """The same vote inside the row, for judges that are column expressions."""
    if not judges:
        return F.lit(False)
    yes = sum((F.when(F.coalesce(j, F.lit(False)), 1).otherwise(0) for j in judges), F.lit(0))
    return yes > len(judges) / 2


def passes(flagged: Column, chars: Column, min_chars: int | None = MIN_CHARS) -> Column:
    """Long enough (unless None) and not flagged; an unknown flag passes."""
    clean = ~F.coalesce(flagged, F.lit(False))
    return clean if min_chars is None else (chars >= min_chars) & clean


def decide(scores: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id") -> DataFrame:
    """Per document: 'resummarize' without scores or with one below the threshold, else 'index'."""
    low = scores.groupBy(id_col).agg(F.count("score").alias("scores"),
                                     F.bool_or(F.col("score") < threshold).alias("low"))
    again = (F.coalesce("scores", F.lit(0)) == 0) | F.coalesce("low", F.lit(False))
    return docs.select(id_col).join(low, id_col, "left").select(
        id_col, F.coalesce("scores", F.lit(0)).alias("scores"),
        F.when(again, "resummarize").otherwise("index").alias("decision"))


def decision_of(scores: Column, threshold: Column | float = THRESHOLD) -> Column:
    """The same decision over an array of scores."""
    low = F.exists(scores, lambda s: s < threshold)
    return F.when(F.coalesce(F.size(scores), F.lit(0)) <= 0, "resummarize").when(low, "resummarize").otherwise("index")


def scored(chunks: DataFrame, column: str = "summary") -> DataFrame:
    return chunks.withColumn("score", summary_score(F.col(column)))


def evaluation_report(chunks: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id") -> DataFrame:
    """Per document: chunks, mean and lowest score, share below the threshold."""
    low = F.when(F.col("score") < threshold, 1.0).otherwise(0.0)
    return chunks.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("chunks"), F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(F.min("score"), 6).alias("min_score"), F.round(F.avg(low), 6).alias("low_share"))


def mean_vector(vectors: DataFrame, group: str, out: str) -> DataFrame:
    """Mean embedding per group; the sums are combined map-side."""
    v = array_to_vector(F.col("embedding").cast("array<double>"))
    return vectors.groupBy(group).agg(vector_to_array(Summarizer.mean(v)).alias(out))


def embedding_drift(baseline: DataFrame, current: DataFrame, group: str) -> DataFrame:
    """L2 distance between the mean vectors of two snapshots, per group."""
    both = mean_vector(baseline, group, "was").join(mean_vector(current, group, "now"), group)
    gap = F.sqrt(F.aggregate(F.zip_with("was", "now", lambda a, b: (a - b) * (a - b)),
                             F.lit(0.0), lambda acc, x: acc + x))
    return both.select(group, F.round(gap, 6).alias("drift"))
