"""Model health, publish guard, strikes and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .log import is_valid


def not_ok(status=None):
    """Health's notion of failure: anything but 'ok', NULL included."""
    status = F.col("status") if status is None else status
    return ~status.eqNullSafe("ok")


def publishable(log: DataFrame, covered_models: DataFrame,
                min_attempts: int = K.HEALTH_MIN_ATTEMPTS,
                fail_pct: float = K.HEALTH_FAIL_PCT) -> DataFrame:
    """Covered models with their publish decision.

    Only ``status = 'error'`` counts as failed here.
    """
    per = (log.join(covered_models.select("model"), "model", "left_semi")
           .groupBy("model")
           .agg(F.count(F.lit(1)).alias("total"),
                F.count_if(F.col("status") == "error").alias("failed")))
    pct = F.col("failed") / F.col("total") * 100
    broken = (F.col("total") >= min_attempts) & (pct >= fail_pct)
    return per.select("model", "total", "failed", pct.alias("failed_pct"),
                      (~broken).alias("publishable"))


def publishable_models(log: DataFrame, covered_models: DataFrame, **kw) -> DataFrame:
    return publishable(log, covered_models, **kw).where("publishable").select("model")


def model_health(log: DataFrame) -> DataFrame:
    """Per-model totals, failures (NULL status counts), mean of non-failed."""
    bad = not_ok()
    g = (log.groupBy("model")
         .agg(F.count(F.lit(1)).alias("total"),
              F.count_if(bad).alias("failed"),
              F.avg(F.when(~bad, F.col("score"))).alias("score_nonfailed")))
    return g.withColumn("failed_pct", F.col("failed") / F.col("total") * 100)


def failing(health: DataFrame, min_attempts: int = K.HEALTH_MIN_ATTEMPTS,
            fail_pct: float = K.HEALTH_FAIL_PCT) -> DataFrame:
    """Rows past the failure bar (G6); works per model or per (model, run)."""
    if "failed_pct" not in health.columns:
        health = health.withColumn("failed_pct", F.col("failed") / F.col("total") * 100)
    return health.where((F.col("total") >= min_attempts) & (F.col("failed_pct") >= fail_pct))


def slow_models(timings: DataFrame, min_attempts: int = K.HEALTH_MIN_ATTEMPTS,
                max_sec: float = K.SLOW_SEC_PER_SAMPLE) -> DataFrame:
    """Models slower than ``max_sec`` per sample over enough attempts."""
    g = (timings.groupBy("model")
         .agg(F.count(F.lit(1)).alias("attempts"),
              (F.sum("seconds") / F.count(F.lit(1))).alias("sec_per_sample")))
    return g.where((F.col("attempts") >= min_attempts) & (F.col("sec_per_sample") > max_sec))


def strike_update(prior: DataFrame, health: DataFrame, slow: DataFrame,
                  min_attempts: int = K.HEALTH_MIN_ATTEMPTS,
                  fail_pct: float = K.HEALTH_FAIL_PCT,
                  immediate_pct: float = K.HEALTH_IMMEDIATE_FAIL_PCT,
                  min_runs: int = K.HEALTH_MIN_RUNS) -> DataFrame:
    """New strike table from the prior one and this run's health.

    Failing models get one more strike; failing badly or slowly means at
    least ``min_runs`` at once; models not failing drop out of the table.
    """
    bad = failing(health, min_attempts, fail_pct).select("model", "failed_pct")
    slow_flag = slow.select("model", F.lit(True).alias("is_slow"))
    j = (bad.join(prior.select("model", F.col("strikes").alias("prior")), "model", "left")
         .join(slow_flag, "model", "left"))
    incremented = F.coalesce(F.col("prior"), F.lit(0)) + 1
    no_grace = (F.col("failed_pct") >= immediate_pct) | F.coalesce(F.col("is_slow"), F.lit(False))
    strikes = F.when(no_grace, F.greatest(incremented, F.lit(min_runs))).otherwise(incremented)
    return j.select("model", strikes.cast("int").alias("strikes"),
                    F.bround(F.col("failed_pct"), 1).alias("failed_pct"))


def strike_history(run_health: DataFrame, slow: DataFrame,
                   min_attempts: int = K.HEALTH_MIN_ATTEMPTS,
                   fail_pct: float = K.HEALTH_FAIL_PCT,
                   immediate_pct: float = K.HEALTH_IMMEDIATE_FAIL_PCT) -> DataFrame:
    """Strikes after every run, from the whole run history at once.

    Gaps and islands: a run that is not failing starts a new island; within
    an island the strike count is the position in the streak, plus one when
    the streak started without grace (the ``greatest(.., 2)`` of G7 only
    lifts the first strike of a streak).  Windows are per model and ordered
    by run number, so one task holds one model's run history only.
    """
    pct = F.col("failed") / F.col("total") * 100
    h = (run_health.withColumn("failed_pct", pct)
         .join(slow.select("model", F.lit(True).alias("is_slow")), "model", "left"))
    is_bad = (F.col("total") >= min_attempts) & (F.col("failed_pct") >= fail_pct)
    no_grace = (F.col("failed_pct") >= immediate_pct) | F.coalesce(F.col("is_slow"), F.lit(False))
    by_run = Window.partitionBy("model").orderBy("run_nr")
    upto = by_run.rowsBetween(Window.unboundedPreceding, 0)
    h = (h.withColumn("_bad", is_bad)
         .withColumn("_island", F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(upto)))
    island = Window.partitionBy("model", "_island").orderBy("run_nr")
    island_upto = island.rowsBetween(Window.unboundedPreceding, 0)
    streak = F.sum(F.when(F.col("_bad"), 1).otherwise(0)).over(island_upto)
    start_no_grace = F.first(F.when(F.col("_bad"), no_grace), ignorenulls=True).over(island_upto)
    strikes = F.when(F.col("_bad"), streak + F.when(start_no_grace, 1).otherwise(0)).otherwise(0)
    return h.select("model", "run_nr", "total", "failed",
                    F.bround(F.col("failed_pct"), 1).alias("failed_pct"),
                    strikes.cast("int").alias("strikes"))


def error_alerts(batch: DataFrame, threshold: float = K.HIGH_ERROR_ALERT) -> DataFrame:
    """Models whose new rows are mostly not ok."""
    g = batch.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(not_ok().cast("double")).alias("error_rate"))
    return g.where(F.col("error_rate") > threshold)


def checkpoint_report(log: DataFrame, published: DataFrame) -> DataFrame:
    """One-row growth/coverage report of a log merge.

    The log is first reduced to one row per model (map-side combined), so
    the join with the published list runs at model grain.
    """
    per_model = log.groupBy("model").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(is_valid()).alias("_valid"))
    pub = published.select("model").distinct().withColumn("_pub", F.lit(True))
    j = per_model.join(pub, "model", "left")
    return j.agg(F.sum("_rows").alias("detailed_rows"),
                 F.count(F.lit(1)).alias("models_in_log"),
                 F.sum("_valid").alias("valid_rows"),
                 F.count_if(F.coalesce(F.col("_pub"), F.lit(False))).alias("models_published"))
