"""Task correlation and score distributions over languages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K

# --- fixed values -----------------------------------------------------------
# Task order of the correlation matrix.
CORRELATION_TASKS = ["translation_from", "translation_to", "classification", "mmlu", "arc", "mgsm"]
# ---------------------------------------------------------------------------


def task_language_means(results: DataFrame) -> DataFrame:
    """Mean score per (task, metric, language), chrF left out."""
    return (results.where(F.col("metric") != "chrf")
            .groupBy("task", "metric", "bcp_47").agg(F.avg("score").alias("score")))


def logit_classification(means: DataFrame, clip=K.LOGIT_CLIP) -> DataFrame:
    """Logit of the clipped classification score; other tasks unchanged."""
    lo, hi = clip
    p = F.least(F.greatest(F.col("score"), F.lit(lo)), F.lit(hi))
    return means.withColumn(
        "score", F.when(F.col("task") == "classification", F.log(p / (1 - p)))
        .otherwise(F.col("score")))


def task_pivot(scores: DataFrame, tasks: Sequence[str] = CORRELATION_TASKS) -> DataFrame:
    """Language x task matrix in fixed task order."""
    return scores.groupBy("bcp_47").agg(
        *[F.avg(F.when(F.col("task") == t, F.col("score"))).alias(t) for t in tasks])


def task_correlation(pivot: DataFrame, tasks: Sequence[str] = CORRELATION_TASKS) -> DataFrame:
    """Pairwise-complete Pearson correlation, lower triangle, in one pass.

    Every pair is one ``corr`` aggregate of the same scan (rows with a NULL
    in either column are skipped per pair); the one-row result is unpivoted.
    """
    pairs = [(tasks[i], tasks[j]) for i in range(len(tasks)) for j in range(i)]
    row = pivot.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    stacked = F.explode(F.array(*[
        F.struct(F.lit(a).alias("task_y"), F.lit(b).alias("task_x"),
                 F.col(f"{a}__{b}").alias("corr")) for a, b in pairs]))
    return row.select(stacked.alias("p")).select("p.*")


def score_histogram(scores: DataFrame, bins: int = 20) -> DataFrame:
    """Counts in ``bins`` equal-width bins between each task's min and max.

    The top edge belongs to the last bin; a task with a single value puts
    everything in bin 0.  Bounds are a per-task aggregate joined back.
    """
    s = scores.where(F.col("score").isNotNull())
    bounds = s.groupBy("task").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("score") - F.col("lo")) / width * bins), F.lit(bins - 1)))
    return (s.join(bounds, "task").withColumn("bin", b.cast("int"))
            .groupBy("task", "bin").agg(F.count(F.lit(1)).alias("n")))


def scatter_pairs(pivot: DataFrame, highlighted: Sequence[str] = (),
                  tasks: Sequence[str] = CORRELATION_TASKS) -> DataFrame:
    """(x, y) points for every ordered task pair where both are present.

    Each language row fans out to the fixed set of task pairs (no join).
    """
    pairs = [(x, y) for y in tasks for x in tasks if x != y]
    pts = F.explode(F.array(*[
        F.struct(F.lit(x).alias("task_x"), F.lit(y).alias("task_y"),
                 F.col(x).alias("x"), F.col(y).alias("y")) for x, y in pairs]))
    hl = F.col("bcp_47").isin(list(highlighted)) if highlighted else F.lit(False)
    return (pivot.select("bcp_47", pts.alias("p")).select("bcp_47", "p.*")
            .where(F.col("x").isNotNull() & F.col("y").isNotNull())
            .withColumn("highlighted", hl)
            .withColumn("label", F.when(F.col("highlighted"), F.col("bcp_47")).otherwise("Other")))
