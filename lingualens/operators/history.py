"""Tier and license histories and record frontiers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.joins import lookup
from ..functions.ordered import desc, global_rank, running
from .leaderboard import model_scores, strict_average, with_task_metric


def model_language_scores(results: DataFrame,
                          metrics: Sequence[str] = K.AVERAGED_METRICS) -> DataFrame:
    """Model x language metric means and strict average."""
    r = with_task_metric(results)
    cols = [F.avg(F.when(F.col("task_metric") == m, F.col("score"))).alias(m) for m in metrics]
    return (r.groupBy("model", "bcp_47").agg(*cols)
            .withColumn("proficiency_score", strict_average(metrics)))


def language_tiers(languages: DataFrame, tiers=K.TIERS) -> DataFrame:
    """Languages with their speaker rank and tier(s).

    Rank 20 belongs to two tiers.  Ties in speakers are broken by code.  The
    tier table is a fixed three-row lookup, so the range join broadcasts it.
    """
    spark = languages.sparkSession
    ranked = global_rank(languages.select("bcp_47", "speakers"),
                         [desc("speakers"), "bcp_47"],
                         out="speaker_rank")
    t = lookup(spark, list(tiers), "tier string, lo int, hi int")
    return (ranked.join(t, (F.col("speaker_rank") >= F.col("lo"))
                        & (F.col("speaker_rank") <= F.col("hi")))
            .select("bcp_47", "speakers", "speaker_rank", "tier"))


HISTORY_META = ["name", "provider_name", "creation_date"]


def _meta(models: DataFrame) -> DataFrame:
    return models.select(F.col("id").alias("model"), *HISTORY_META, "type")


def tier_scores(results: DataFrame, languages: DataFrame, models: DataFrame) -> DataFrame:
    """Mean proficiency per model and language tier, with metadata."""
    mls = model_language_scores(results)
    tiers = language_tiers(languages).select("bcp_47", "tier")
    per = (mls.join(tiers, "bcp_47")
           .groupBy("model", "tier").agg(F.avg("proficiency_score").alias("proficiency_score")))
    return (per.join(_meta(models), "model", "left")
            .select("model", *HISTORY_META, "tier", "proficiency_score"))


def license_class(type_col: Column) -> Column:
    """'Open-source' for open-source models, 'Commercial' otherwise, NULL included (I4)."""
    return F.when(type_col.eqNullSafe("open-source"), "Open-source").otherwise("Commercial")


def license_history(results: DataFrame, models: DataFrame) -> DataFrame:
    """Model proficiency with license class and metadata (I4)."""
    s = model_scores(results).select("model", F.col("average").alias("proficiency_score"))
    return (s.join(_meta(models), "model", "left")
            .select("model", *HISTORY_META, license_class(F.col("type")).alias("license_type"),
                    "proficiency_score"))


def record_frontier(df: DataFrame, value: str, order: Sequence[Column | str],
                    partition_by: Sequence[str] = (), max_col: str = "max_score") -> DataFrame:
    """Running record of ``value`` along ``order``.

    The record before the first row is 0; a row sets a new record when its
    value is strictly above the best of all earlier rows.
    """
    prev = running(df, order, F.col(value), "max", "_prev", partition_by, inclusive=False)
    best_before = F.coalesce(F.col("_prev"), F.lit(0.0))
    return (prev.withColumn(max_col, F.greatest(best_before, F.col(value)))
            .withColumn("new_record", F.col(value) > best_before)
            .drop("_prev"))


def frontier_by_date(board: DataFrame) -> DataFrame:
    """Record average over release date; a missing date sorts first.

    Equal dates keep leaderboard order (rank).
    """
    b = board.where(F.col("average").isNotNull())
    f = record_frontier(b, "average", ["creation_date", "rank"],
                        max_col="max_average")
    return f.select("model", "creation_date", "average", "max_average", "new_record")


def frontier_by_cost(board: DataFrame) -> DataFrame:
    """Record average over cost, for priced models."""
    b = board.where(F.col("average").isNotNull() & (F.col("cost") > 0))
    f = record_frontier(b, "average", [F.col("cost"), F.col("rank")], max_col="max_average")
    return f.select("model", "cost", "average", "max_average", "new_record")


def frontier_by_group(history: DataFrame, group: str) -> DataFrame:
    """Record proficiency over date per tier or license class."""
    h = history.where(F.col("proficiency_score").isNotNull() & F.col("creation_date").isNotNull())
    f = record_frontier(h, "proficiency_score", [F.col("creation_date"), F.col("model")],
                        partition_by=[group])
    return f.select(group, "model", "creation_date", "proficiency_score", "max_score", "new_record")


def frontier_steps(frontier: DataFrame, group: str | None, end, x: str = "creation_date",
                   y: str = "max_score") -> DataFrame:
    """Step line per group (or one line): the record rows plus an end point
    at ``end``, a date or the last point of the axis (I9)."""
    keys = [group] if group else []
    rec = frontier.where("new_record").select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    last = rec.groupBy(*keys).agg(F.max("y").alias("y")).where(F.col("y").isNotNull())
    end = end if isinstance(end, Column) else F.lit(end)
    return rec.unionByName(last.select(*keys, end.alias("x"), "y"))
