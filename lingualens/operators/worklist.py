"""Evaluation worklist and resumption.

The worklist is task x model x language x sample, restricted to the tasks of
each model and to the languages that have data for the task.  It is built
without a cartesian product: (model, task) rows join the (task, language)
table on ``task`` -- a table bounded by tasks x the language cap, so it is
broadcast and the join streams -- and the samples are a fixed ``sequence``
exploded per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.joins import bounded
from ..functions.ordered import global_rank
from .log import is_valid

WORK_KEY = ["task", "model", "bcp_47", "sentence_nr"]


def top_languages(languages: DataFrame, n: int = K.N_LANGUAGES) -> DataFrame:
    """The ``n`` most spoken languages; ties by name, descending."""
    return (languages.orderBy(F.col("speakers").desc(), F.col("language_name").desc())
            .limit(n))


def cohort_models(models: DataFrame, n: int = K.N_MODELS) -> DataFrame:
    """The first ``n`` models in cohort (id) order with their position."""
    first = models.orderBy("id").limit(n)
    return global_rank(first, ["id"], out="position").withColumnRenamed("id", "model")


def valid_task_languages(*sources: DataFrame) -> DataFrame:
    """(task, bcp_47) pairs with data: union of the sub-datasets' keys."""
    out = None
    for s in sources:
        k = s.select("task", "bcp_47")
        out = k if out is None else out.unionByName(k)
    return out.distinct()


def worklist(cohort: DataFrame, languages: DataFrame, valid: DataFrame,
             tasks: Sequence[str] = K.TASKS, n_sentences: int = K.N_SENTENCES,
             max_languages: int = K.N_LANGUAGES) -> DataFrame:
    """Every (task, model, language, sample) to evaluate.

    ``cohort`` has ``model`` and optionally a ``tasks`` array (default: all
    ``tasks``); ``languages`` is already capped at ``max_languages`` rows.
    """
    model_tasks = cohort.select(
        "model", F.explode(F.col("tasks") if "tasks" in cohort.columns
                           else F.array(*[F.lit(t) for t in tasks])).alias("task"))
    task_langs = valid.join(languages.select("bcp_47"), "bcp_47", "left_semi")
    task_langs = bounded(task_langs.select("task", "bcp_47"), len(tasks) * max_languages)
    return (model_tasks.join(task_langs, "task")
            .select("task", "model", "bcp_47",
                    F.explode(F.sequence(F.lit(0), F.lit(n_sentences - 1))).alias("sentence_nr")))


def pending(work: DataFrame, log: DataFrame) -> DataFrame:
    """Work items without a completed (ok or status-less) log row."""
    done = log.where(is_valid()).select(*WORK_KEY)
    return work.join(done, WORK_KEY, "left_anti")


def pending_counts(pend: DataFrame, cohort: DataFrame) -> DataFrame:
    """Pending items per model, in cohort order (D3)."""
    counts = pend.groupBy("model").agg(F.count(F.lit(1)).alias("pending"))
    return counts.join(cohort.select("model", "position"), "model")


def coverage(work: DataFrame, pend: DataFrame, cohort: DataFrame) -> DataFrame:
    """Expected vs pending items per cohort model; covered = nothing pending."""
    exp = work.groupBy("model").agg(F.count(F.lit(1)).alias("expected"))
    pen = pend.groupBy("model").agg(F.count(F.lit(1)).alias("pending"))
    j = (cohort.select("model").join(exp, "model", "left").join(pen, "model", "left")
         .fillna(0, ["expected", "pending"]))
    ratio = F.when(F.col("expected") > 0,
                   (F.col("expected") - F.col("pending")) / F.col("expected"))
    return j.select("model", "expected", "pending", ratio.alias("done_ratio"),
                    (F.col("pending") == 0).alias("covered"))
