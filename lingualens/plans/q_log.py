"""Log maintenance and model health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import health
from .context import PUBLISH_FAIL_PCT, PUBLISH_MIN_ATTEMPTS
from .registry import query

# Bars for the per-run health table (FIXTURES: 100 attempts never triggers).
RUN_MIN_ATTEMPTS = 20
RUN_FAIL_PCT = 50.0
ALERT_THRESHOLD = 0.2


@query("log_keep_last", ["kl"], "SELECT * FROM kl")
def log_keep_last(ctx):
    """G1: last row per (task, model, language, metric, sample)."""
    return ctx.detailed


@query("valid_rows", ["valid"], "SELECT * FROM valid")
def valid_rows(ctx):
    """Completed samples (status ok or absent)."""
    return ctx.valid


@query("publishable", ["kl", "cov"], f"""
SELECT model, count(*) AS total, count(*) FILTER (WHERE status = 'error') AS failed,
  count(*) FILTER (WHERE status = 'error') / count(*) * 100 AS failed_pct,
  NOT (count(*) >= {PUBLISH_MIN_ATTEMPTS}
       AND count(*) FILTER (WHERE status = 'error') / count(*) * 100 >= {PUBLISH_FAIL_PCT}) AS publishable
FROM kl WHERE model IN (SELECT model FROM cov) GROUP BY model""")
def publishable(ctx):
    """Publish decision per covered model."""
    return ctx.guard.where("covered").select("model", "total", "failed", "failed_pct", "publishable")


@query("result_aggregate", ["results"], "SELECT * FROM results")
def result_aggregate(ctx):
    """Mean score and first origin per (model, language, task, metric)."""
    return ctx.results


@query("model_health", ["kl"], """
SELECT model, count(*) AS total, count(*) FILTER (WHERE status IS DISTINCT FROM 'ok') AS failed,
  avg(score) FILTER (WHERE status IS NOT DISTINCT FROM 'ok') AS score_nonfailed,
  count(*) FILTER (WHERE status IS DISTINCT FROM 'ok') / count(*) * 100 AS failed_pct
FROM kl GROUP BY model""")
def model_health(ctx):
    """Per-model health of the merged log."""
    return health.model_health(ctx.detailed)


@query("failing_models", ["run_health"], f"""
SELECT model, run_nr, total, CAST(failed AS BIGINT) AS failed, failed / total * 100 AS failed_pct
FROM run_health WHERE total >= {RUN_MIN_ATTEMPTS} AND failed / total * 100 >= {RUN_FAIL_PCT}""")
def failing_models(ctx):
    """(model, run) pairs past the failure bar."""
    return health.failing(ctx.view("run_health"), RUN_MIN_ATTEMPTS, RUN_FAIL_PCT)


def _slow(ctx):
    return health.slow_models(ctx.view("timings"))


def _history(ctx):
    return health.strike_history(ctx.view("run_health"), _slow(ctx),
                                 RUN_MIN_ATTEMPTS, RUN_FAIL_PCT)


# The oracle computes strikes run by run with the update rule of G7 (a
# recursive CTE), an independent formulation of the windowed G8 query.
_STRIKE_CTES = [
    ("slow", """SELECT model FROM timings GROUP BY model
                HAVING count(*) >= 100 AND sum(seconds) / count(*) > 0.3"""),
    ("h", f"""SELECT r.model, r.run_nr, r.total, CAST(r.failed AS BIGINT) AS failed,
                 r.failed / r.total * 100 AS pct,
                 r.total >= {RUN_MIN_ATTEMPTS} AND r.failed / r.total * 100 >= {RUN_FAIL_PCT} AS bad,
                 (r.failed / r.total * 100 >= 80) OR (s.model IS NOT NULL) AS no_grace
              FROM run_health r LEFT JOIN slow s ON s.model = r.model"""),
    ("rec", """SELECT model, run_nr, CASE WHEN bad THEN CASE WHEN no_grace THEN 2 ELSE 1 END ELSE 0 END AS strikes
               FROM h WHERE run_nr = 0
               UNION ALL
               SELECT h.model, h.run_nr,
                 CASE WHEN h.bad THEN CASE WHEN h.no_grace THEN greatest(rec.strikes + 1, 2)
                                           ELSE rec.strikes + 1 END ELSE 0 END
               FROM rec JOIN h ON h.model = rec.model AND h.run_nr = rec.run_nr + 1"""),
]


@query("strike_streaks", ["run_health", "timings"], """
SELECT h.model, h.run_nr, h.total, h.failed, round_even(h.pct, 1) AS failed_pct,
  CAST(rec.strikes AS INTEGER) AS strikes
FROM h JOIN rec ON rec.model = h.model AND rec.run_nr = h.run_nr""", _STRIKE_CTES, recursive=True)
def strike_streaks(ctx):
    """Strikes after every run, computed from the whole history at once."""
    return _history(ctx)


@query("strike_update", ["run_health", "timings"], """
SELECT h.model,
  CAST(CASE WHEN h.no_grace THEN greatest(coalesce(p.strikes, 0) + 1, 2)
            ELSE coalesce(p.strikes, 0) + 1 END AS INTEGER) AS strikes,
  round_even(h.pct, 1) AS failed_pct
FROM h LEFT JOIN rec p ON p.model = h.model AND p.run_nr = 8 AND p.strikes > 0
WHERE h.run_nr = 9 AND h.bad""", _STRIKE_CTES, recursive=True)
def strike_update(ctx):
    """Strike table after run 9 from the table after run 8 and run 9's health."""
    prior = (_history(ctx).where((F.col("run_nr") == 8) & (F.col("strikes") > 0))
             .select("model", "strikes"))
    current = ctx.view("run_health").where(F.col("run_nr") == 9)
    return health.strike_update(prior, current, _slow(ctx), RUN_MIN_ATTEMPTS, RUN_FAIL_PCT)


@query("error_alerts", ["result_log"], f"""
SELECT model, count(*) AS n_rows,
  avg(CASE WHEN status IS DISTINCT FROM 'ok' THEN 1.0e0 ELSE 0.0e0 END) AS error_rate
FROM result_log GROUP BY model
HAVING avg(CASE WHEN status IS DISTINCT FROM 'ok' THEN 1.0e0 ELSE 0.0e0 END) > {ALERT_THRESHOLD}""")
def error_alerts(ctx):
    """Models whose incoming rows are mostly not ok."""
    return health.error_alerts(ctx.log, ALERT_THRESHOLD)


@query("checkpoint_report", ["kl", "pub"], """
SELECT count(*) AS detailed_rows, count(DISTINCT model) AS models_in_log,
  count(*) FILTER (WHERE status IS NULL OR status = 'ok') AS valid_rows,
  (SELECT count(*) FROM pub) AS models_published
FROM kl""")
def checkpoint_report(ctx):
    """Rows and models after a merge."""
    return health.checkpoint_report(ctx.detailed, ctx.published)


@query("slow_models", ["timings"], """
SELECT model, count(*) AS attempts, sum(seconds) / count(*) AS sec_per_sample
FROM timings GROUP BY model HAVING count(*) >= 100 AND sum(seconds) / count(*) > 0.3""")
def slow_models(ctx):
    """Models slower than 0.3 s per sample over at least 100 attempts."""
    return _slow(ctx)


@query("publish_decision", ["models", "languages"], f"""
SELECT (SELECT count(DISTINCT id) FROM models) AS n_models,
  (SELECT count(DISTINCT bcp_47) FROM languages) AS n_languages,
  (SELECT count(DISTINCT id) FROM models) >= {K.PUBLISH_MIN_MODELS}
    AND (SELECT count(DISTINCT bcp_47) FROM languages) >= {K.PUBLISH_MIN_LANGUAGES} AS publish_aggregates""")
def publish_decision(ctx):
    """A4: may this run overwrite the published aggregates (full scale only)?"""
    from ..sources.io import publish_target
    return publish_target(ctx.models.select(F.col("id").alias("model")), ctx.languages)
