"""Worklist and resumption queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.joins import FIXED_ROWS
from ..operators import worklist as wl
from .registry import query

N_LANGUAGES = K.N_LANGUAGES
N_MODELS = K.N_MODELS

_CTES = [
    ("top_lang", f"SELECT bcp_47 FROM languages ORDER BY speakers DESC, language_name DESC LIMIT {N_LANGUAGES}"),
    ("cohort", f"""SELECT model, row_number() OVER (ORDER BY model) AS position
                  FROM (SELECT id AS model FROM models ORDER BY id LIMIT {N_MODELS})"""),
    ("valid_tl", "SELECT DISTINCT task, bcp_47 FROM result_log"),
    ("tasks", "SELECT unnest([" + ", ".join(f"'{t}'" for t in K.TASKS) + "]) AS task"),
    ("wl", f"""SELECT v.task, c.model, v.bcp_47, CAST(s.sentence_nr AS INTEGER) AS sentence_nr
              FROM cohort c CROSS JOIN tasks t JOIN valid_tl v ON v.task = t.task
              JOIN top_lang l ON l.bcp_47 = v.bcp_47 CROSS JOIN range(0, {K.N_SENTENCES}) s(sentence_nr)"""),
    ("pend", """SELECT * FROM wl WHERE NOT EXISTS (
                 SELECT 1 FROM valid v WHERE v.task = wl.task AND v.model = wl.model
                   AND v.bcp_47 = wl.bcp_47 AND v.sentence_nr = wl.sentence_nr)"""),
]
_USES = ["languages", "models", "result_log", "valid"]
# The same work for every model and language.
_WHOLE = {"top_lang": "SELECT bcp_47 FROM languages", "cohort": "SELECT id AS model FROM models"}
_ALL_CTES = [(name, _WHOLE.get(name, sql)) for name, sql in _CTES]


def _parts(ctx):
    cohort = wl.cohort_models(ctx.models, N_MODELS)
    langs = wl.top_languages(ctx.languages, N_LANGUAGES)
    valid = wl.valid_task_languages(ctx.log)
    work = wl.worklist(cohort, langs, valid)
    return cohort, work, wl.pending(work, ctx.detailed)


@query("worklist_pending", _USES, "SELECT * FROM pend", _ALL_CTES)
def worklist_pending(ctx):
    """All (task, model, language, sample) items not yet completed, of
    every model and language."""
    work = wl.worklist(ctx.models.select(F.col("id").alias("model")), ctx.languages, wl.valid_task_languages(ctx.log),
                       max_languages=FIXED_ROWS["nation"])
    return wl.pending(work, ctx.detailed)


@query("pending_counts", _USES, """
SELECT p.model, count(*) AS pending, c.position FROM pend p JOIN cohort c ON c.model = p.model
GROUP BY p.model, c.position""", _CTES)
def pending_counts(ctx):
    """D3: pending items per model with cohort position."""
    cohort, _, pend = _parts(ctx)
    return wl.pending_counts(pend, cohort)


@query("coverage", _USES, """
SELECT c.model, coalesce(e.expected, 0) AS expected, coalesce(p.pending, 0) AS pending,
  CASE WHEN coalesce(e.expected, 0) > 0
       THEN (coalesce(e.expected, 0) - coalesce(p.pending, 0)) / coalesce(e.expected, 0) END AS done_ratio,
  coalesce(p.pending, 0) = 0 AS covered
FROM cohort c
LEFT JOIN (SELECT model, count(*) AS expected FROM wl GROUP BY model) e ON e.model = c.model
LEFT JOIN (SELECT model, count(*) AS pending FROM pend GROUP BY model) p ON p.model = c.model""", _CTES)
def coverage(ctx):
    """Expected vs pending items; coverage-complete models."""
    cohort, work, pend = _parts(ctx)
    return wl.coverage(work, pend, cohort)


@query("coverage_bitmap", ["matrix"], """
SELECT model, count(*) AS expected, count(*) FILTER (WHERE done) AS attempted, bool_and(done) AS covered
FROM matrix GROUP BY model""")
def coverage_bitmap(ctx):
    """Cells of each model's matrix and those attempted, from bitmaps."""
    return ctx.guard.select("model", "expected", "attempted", "covered")


@query("valid_task_languages", ["result_log"], "SELECT DISTINCT task, bcp_47 FROM result_log")
def valid_task_languages(ctx):
    """(task, language) pairs that have data."""
    return wl.valid_task_languages(ctx.log)


@query("top_languages", ["languages"], f"""
SELECT * FROM languages ORDER BY speakers DESC, language_name DESC LIMIT {N_LANGUAGES}""")
def top_languages(ctx):
    """Most spoken languages first, top N."""
    return wl.top_languages(ctx.languages, N_LANGUAGES)
