"""Coverage of the evaluation matrix as bitmaps, and the publish guard on it.

The matrix of a task is its languages times ``n_slots`` samples.  Cells are
numbered within their task, and a model's attempts on a task are the bits of
64-bit words: ``bit_or`` is an ordinary aggregate with a fixed-width buffer, so
attempts are combined map-side whatever their number, and a model's matrix is a
few words.  They are compared with the words that the model's tasks ask for;
the worklist itself, a row for each cell, is never built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.joins import bounded


def expected_languages(valid: DataFrame, languages: DataFrame, n_tasks: int = len(K.TASKS),
                       max_languages: int = K.N_LANGUAGES) -> DataFrame:
    """(task, bcp_47) pairs to evaluate: languages with data for the task,
    within a list of at most ``max_languages``."""
    pairs = valid.join(languages.select("bcp_47"), "bcp_47", "left_semi").select("task", "bcp_47").distinct()
    return bounded(pairs, n_tasks * max_languages)


def numbered(expected: DataFrame, n_slots: int) -> DataFrame:
    """task, bcp_47 and the number of the pair's first cell within its task."""
    in_task = Window.partitionBy("task").orderBy("bcp_47")  # at most as many rows as languages
    return expected.select("task", "bcp_47", ((F.row_number().over(in_task) - 1) * n_slots).alias("first_cell"))


def _word(cell):
    return F.floor(cell / 64).cast("int")


def _bit(cell):
    return F.expr(f"shiftleft(1L, cast({cell} % 64 as int))")


def asked_words(cells: DataFrame, n_slots: int) -> DataFrame:
    """task, word, mask: the cells that a task has."""
    c = cells.select("task", F.explode(F.sequence(F.col("first_cell"), F.col("first_cell") + n_slots - 1)).alias("cell"))
    return c.groupBy("task", _word(F.col("cell")).alias("word")).agg(F.bit_or(_bit("cell")).alias("mask"))


def attempted_words(log: DataFrame, cells: DataFrame, n_slots: int) -> DataFrame:
    """model, task, word, bits of the attempted cells, and the word's rows and
    errors; rows outside the matrix are in word -1."""
    at = log.select("model", "task", "bcp_47", "sentence_nr", "status").join(
        bounded(cells, len(K.TASKS) * K.N_LANGUAGES), ["task", "bcp_47"], "left")
    at = at.withColumn("cell", F.col("first_cell") + F.pmod(F.col("sentence_nr"), F.lit(n_slots)))
    return (at.groupBy("model", "task", F.coalesce(_word(F.col("cell")), F.lit(-1)).alias("word"))
            .agg(F.bit_or(F.when(F.col("cell").isNotNull(), _bit("cell"))).alias("bits"),
                 F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "error").alias("errors")))


def guard(log: DataFrame, cohort: DataFrame, expected: DataFrame, n_slots: int = K.N_SENTENCES,
          min_attempts: int = K.HEALTH_MIN_ATTEMPTS, fail_pct: float = K.HEALTH_FAIL_PCT) -> DataFrame:
    """Per cohort model: expected and attempted cells, whether it is covered,
    its log rows and errors, and whether it may be published (D4, G3).

    ``cohort`` has ``model`` and its ``tasks``; ``expected`` the (task,
    bcp_47) pairs.  A sample number counts modulo ``n_slots``, the samples
    asked of a pair.  Covered means every expected cell attempted, ok or not; a
    model of which nothing is expected isn't covered.  A covered model is held
    back when it has ``min_attempts`` rows and ``fail_pct`` % errors.
    """
    cells = numbered(expected, n_slots)
    asked = (cohort.select("model", F.explode("tasks").alias("task"))
             .join(bounded(asked_words(cells, n_slots), len(K.TASKS) * K.N_LANGUAGES * n_slots), "task"))
    words = attempted_words(log, cells, n_slots).join(cohort.select("model"), "model", "left_semi")
    none = F.lit(0).cast("long")
    per = (asked.join(words, ["model", "task", "word"], "full").groupBy("model")
           .agg(F.sum(F.coalesce(F.bit_count("mask"), none)).alias("expected"),
                F.sum(F.coalesce(F.bit_count(F.col("mask").bitwiseAND(F.col("bits"))), none)).alias("attempted"),
                F.sum(F.coalesce("rows", none)).alias("total"), F.sum(F.coalesce("errors", none)).alias("failed")))
    covered = (F.col("expected") > 0) & (F.col("attempted") == F.col("expected"))
    pct = F.when(F.col("total") > 0, F.col("failed") / F.col("total") * 100)
    broken = (F.col("total") >= min_attempts) & (pct >= fail_pct)
    return per.select("model", "expected", "attempted", covered.alias("covered"), "total", "failed",
                      pct.alias("failed_pct"), (covered & ~F.coalesce(broken, F.lit(False))).alias("publishable"))
