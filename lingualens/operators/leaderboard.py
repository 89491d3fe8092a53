"""Model and language leaderboards.

Pivots use a *fixed* list of metric columns, written as conditional
aggregates: one hash aggregation with map-side combine, a fixed output
schema, and no extra job to discover pivot values.  Metrics absent from the
data come out as NULL columns (H4).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.joins import bounded
from ..functions.ordered import desc, global_rank
from .bootstrap import metric_intervals, wide_intervals

ORIGINS = ["human", "machine"]


def with_task_metric(df: DataFrame) -> DataFrame:
    """Composite keys ``task_metric`` and ``task_metric_origin`` (H1)."""
    out = df.withColumn("task_metric", F.concat_ws("_", "task", "metric"))
    if "origin" in df.columns:
        out = out.withColumn("task_metric_origin",
                             F.concat_ws("_", "task", "metric", "origin"))
    return out


def pivot_agg(df: DataFrame, keys: Sequence[str], pivot_col: str, values: Iterable[str],
              value_col: str = "score", agg=F.avg, suffix: str = "") -> DataFrame:
    """``groupBy(keys).pivot(pivot_col, values).agg(agg(value_col))`` as one
    conditional aggregation (H2, H4)."""
    cols = [agg(F.when(F.col(pivot_col) == v, F.col(value_col))).alias(f"{v}{suffix}")
            for v in values]
    return df.groupBy(*keys).agg(*cols)


def strict_average(metrics: Sequence[str] = K.AVERAGED_METRICS) -> Column:
    """Mean of the metric columns; NULL as soon as one is missing (H5)."""
    total = F.col(metrics[0])
    for m in metrics[1:]:
        total = total + F.col(m)
    return total / len(metrics)


def model_scores(results: DataFrame, metrics: Sequence[str] = K.AVERAGED_METRICS,
                 with_origin: bool = False) -> DataFrame:
    """Model x metric means and the strict average (H2-H5).

    ``with_origin`` adds ``{metric}_{origin}`` columns from the same single
    aggregation instead of a second pivot and an outer merge (H3).
    """
    r = with_task_metric(results)
    return (r.groupBy("model").agg(*_mean_columns(metrics, with_origin))
            .withColumn("average", strict_average(metrics)))


def _mean_columns(metrics: Sequence[str], with_origin: bool) -> list[Column]:
    cols = [F.avg(F.when(F.col("task_metric") == m, F.col("score"))).alias(m) for m in metrics]
    if with_origin:
        cols += [F.avg(F.when(F.col("task_metric_origin") == f"{m}_{o}", F.col("score")))
                 .alias(f"{m}_{o}") for m in metrics for o in ORIGINS]
    return cols


def _flag_columns(metrics: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.bool_or(F.when(F.col("task_metric") == m, F.col("origin") == "machine")), F.lit(False))
            .alias(f"{m}_contains_machine") for m in metrics]


def machine_flags(results: DataFrame, metrics: Sequence[str] = K.AVERAGED_METRICS) -> DataFrame:
    """Per model and metric: does any aggregated cell come from machine
    translation (H6)?  False, not NULL, where the metric has no rows."""
    return with_task_metric(results).groupBy("model").agg(*_flag_columns(metrics))


MODEL_META = ["name", "provider_name", "creation_date", "type", "cost", "hf_id", "size", "license"]


def rank_models(scores: DataFrame, models: DataFrame, meta: Sequence[str] = MODEL_META) -> DataFrame:
    """Rank by average (NULL last, then model id) and attach metadata (H7)."""
    ranked = global_rank(scores, [desc("average"), "model"])
    m = models.select(F.col("id").alias("model"), *meta)
    return ranked.join(m, "model", "left")


def model_table(results: DataFrame, models: DataFrame,
                metrics: Sequence[str] = K.AVERAGED_METRICS) -> DataFrame:
    """Leaderboard rows in display column order (H1, H2, H4, H5, H7, H8)."""
    t = rank_models(model_scores(results, metrics), models)
    return t.select("rank", "model", *MODEL_META, "average", *sorted(metrics))


def full_model_table(results: DataFrame, samples: DataFrame, models: DataFrame,
                     metrics: Sequence[str] = K.AVERAGED_METRICS) -> DataFrame:
    """The model table with everything a reader sees at once: metadata, means
    overall and by origin, machine flags, and intervals per metric and for
    the average (H1-H8, H14, H15).

    Means and flags are one aggregation of the published cells.  ``samples``
    are the rows behind the intervals: the merged log or, with a count ``n``,
    its cube.
    """
    r = with_task_metric(results)
    scores = r.groupBy("model").agg(*_mean_columns(metrics, with_origin=True), *_flag_columns(metrics))
    ranked = rank_models(scores.withColumn("average", strict_average(metrics)), models)
    intervals = wide_intervals(metric_intervals(samples, "model", metrics), "model", metrics)
    parts = [f"{m}_{o}" for m in metrics for o in ORIGINS]
    return (ranked.select("rank", "model", *MODEL_META, "average", *sorted(metrics), *parts,
                          *[f"{m}_contains_machine" for m in metrics])
            .join(intervals, "model", "left"))


def language_board(cells: DataFrame, languages: DataFrame, metrics: Sequence[str] = K.AVERAGED_METRICS,
                   shown: Sequence[str] | None = None) -> DataFrame:
    """``language_table`` from guarded cells (H9-H11): the means of all
    samples and the first origins of the published ones are one aggregation.
    ``shown`` metrics have columns, ``metrics`` make the average."""
    c, averaged, metrics = with_task_metric(cells), metrics, shown or metrics
    is_m = {m: F.col("task_metric") == m for m in metrics}
    means = [(F.sum(F.when(is_m[m], F.col("total"))) / F.sum(F.when(is_m[m] & (F.col("n") > 0), F.col("n")))).alias(m) for m in metrics]
    origins = [F.min_by(F.when(is_m[m] & F.col("published"), F.col("origin")),
                        F.when(is_m[m] & F.col("published"), F.col("model"))).alias(f"{m}_origin") for m in metrics]
    scores = c.groupBy("bcp_47").agg(F.bool_or("published").alias("_any"), *means, *origins).where("_any").drop("_any")
    lang_cols = [x for x in ["language_name", "autonym", "speakers", "family", "in_benchmark"] if x in languages.columns]
    t = languages.select("bcp_47", *lang_cols).join(scores, "bcp_47", "full")
    return t.select("bcp_47", *lang_cols, strict_average(averaged).alias("average"),
                    *sorted(metrics), *sorted(f"{m}_origin" for m in metrics))


def language_table(results: DataFrame, detailed: DataFrame, languages: DataFrame,
                   metrics: Sequence[str] = K.AVERAGED_METRICS) -> DataFrame:
    """Language leaderboard.

    Metric means come from *all* detailed samples (as the intervals do); the
    ``_origin`` columns are the first origin per metric in results order
    (model id order).  A language of the results gets the means of all its
    samples; a language that has samples but no published result has none.
    Languages without scores stay, scores without a language row stay (full
    outer join).
    """
    r = with_task_metric(results)
    origins = r.groupBy("bcp_47").agg(*[
        F.min_by(F.when(F.col("task_metric") == m, F.col("origin")),
                 F.when(F.col("task_metric") == m, F.col("model"))).alias(f"{m}_origin")
        for m in metrics])
    means = pivot_agg(with_task_metric(detailed), ["bcp_47"], "task_metric", metrics)
    scores = origins.join(means, "bcp_47", "left")
    lang_cols = [c for c in ["language_name", "autonym", "speakers", "family", "in_benchmark"]
                 if c in languages.columns]
    t = languages.select("bcp_47", *lang_cols).join(scores, "bcp_47", "full")
    return t.select("bcp_47", *lang_cols, strict_average(metrics).alias("average"),
                    *sorted(metrics), *sorted(f"{m}_origin" for m in metrics))


def select_languages(df: DataFrame, selected: DataFrame | None) -> DataFrame:
    """Keep rows of the selected languages; no selection, or an empty one,
    keeps everything (H12).  The selection is a request's, at most the list of
    languages: broadcast, so rows aren't dealt by their few languages."""
    if selected is None:
        return df
    chosen = selected.select(F.col("bcp_47").alias("_selected")).distinct()
    n = chosen.agg(F.count(F.lit(1))).scalar()
    return (df.join(bounded(chosen, K.N_LANGUAGES), F.col("bcp_47") == F.col("_selected"), "left")
            .where(F.col("_selected").isNotNull() | (n == 0)).drop("_selected"))


def by_speakers(table: DataFrame) -> DataFrame:
    """A language table in display order: most speakers first."""
    return table.orderBy(F.col("speakers").desc_nulls_last(), F.col("bcp_47"))


def machine_metrics(results: DataFrame) -> DataFrame:
    """Metrics that have machine-translated rows."""
    return (with_task_metric(results).where(F.col("origin") == "machine")
            .select("task_metric").distinct())


def group_stats(detailed: DataFrame, group_col: str,
                metrics: Sequence[str] = K.AVERAGED_METRICS) -> DataFrame:
    """count / mean / sample std of scores per group and metric."""
    d = with_task_metric(detailed).where(F.col("task_metric").isin(list(metrics)))
    return (d.groupBy(group_col, "task_metric")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"),
                 F.stddev_samp("score").alias("std")))
