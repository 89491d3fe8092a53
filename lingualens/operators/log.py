"""Per-sample result log: keep-last merge, valid rows, published aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.joins import bounded

# A cell of the published aggregate, and the per-sample key within it.
CELL = ["model", "bcp_47", "task", "metric"]
LOG_KEY = [*CELL, "sentence_nr"]
# Log order: a later row wins on merge; the earliest row is "first".
LOG_ORDER = ["logged_at", "tie1", "tie2", "tie3"]
AGG_KEY = CELL


def log_order(order: Sequence[str] = LOG_ORDER) -> Column:
    return F.struct(*order)


def keep_last(log: DataFrame, key: Sequence[str] = LOG_KEY,
              order: Sequence[str] = LOG_ORDER) -> DataFrame:
    """Last row per key in log order (G1).

    ``max`` of a struct that leads with the order columns is an ordinary
    aggregate, so Spark combines copies map-side before the shuffle: even a
    key whose copies are a third of all rows reaches the reduce side as one
    row per map task, never as one task's worth of raw rows.  The remaining
    columns break exact ties deterministically.
    """
    key = list(key)
    rest = [c for c in log.columns if c not in key and c not in order]
    latest = F.max(F.struct(*order, *rest)).alias("_last")
    return (log.groupBy(*key).agg(latest)
            .select(*key, *[F.col(f"_last.{c}").alias(c) for c in [*order, *rest]]))


def is_valid(status: Column | None = None) -> Column:
    """A completed sample: status ok, or no status (old rows)."""
    status = F.col("status") if status is None else status
    return status.isNull() | (status == "ok")


def valid_rows(log: DataFrame) -> DataFrame:
    return log.where(is_valid())


def aggregate_results(valid: DataFrame, publishable_models: DataFrame | None = None,
                      cohort_languages: DataFrame | None = None,
                      order: Sequence[str] = LOG_ORDER) -> DataFrame:
    """Mean score and first origin per (model, language, task, metric).

    ``publishable_models`` (column ``model``) and ``cohort_languages``
    (column ``bcp_47``) restrict the rows by semi joins.
    """
    v = valid
    if publishable_models is not None:
        v = v.join(publishable_models.select("model"), "model", "left_semi")
    if cohort_languages is not None:
        v = v.join(cohort_languages.select("bcp_47"), "bcp_47", "left_semi")
    return (v.groupBy(*AGG_KEY)
            .agg(F.avg("score").alias("score"),
                 F.min_by("origin", log_order(order)).alias("origin")))


def log_cells(detailed: DataFrame, order: Sequence[str] = LOG_ORDER, n_slots: int = 1) -> DataFrame:
    """Every cell of the merged log reduced once to mergeable statistics.

    ``n``, ``total``, ``squares``: count, sum and sum of squares of all scores;
    ``valid_n``, ``valid_total`` and ``origin``: of the valid rows, with their
    first origin; ``errors``; ``slots``: bits of the attempted samples (modulo
    ``n_slots``, at most 63).
    """
    if not 0 < n_slots < 64:
        raise ValueError("a cell's samples are the bits of one word: use coverage.guard beyond 63")
    valid, score = is_valid(), F.col("score")
    return detailed.groupBy(*CELL).agg(
        F.count("score").alias("n"), F.sum("score").alias("total"), F.sum(score * score).alias("squares"),
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(valid).alias("valid_rows"), F.count(F.when(valid, score)).alias("valid_n"),
        F.sum(F.when(valid, score)).alias("valid_total"),
        F.min_by(F.when(valid, F.col("origin")), F.when(valid, log_order(order))).alias("origin"),
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(sentence_nr, {n_slots}) as int))")).alias("slots"))


def _counts(order: Sequence[str], n_slots: int) -> dict[str, Column]:
    """The statistics of a cube's row."""
    if not 0 < n_slots < 64:
        raise ValueError("a cell's samples are the bits of one word: use coverage.guard beyond 63")
    valid = is_valid()
    return {"n": F.count(F.lit(1)), "errors": F.count_if(F.col("status") == "error"), "valid_rows": F.count_if(valid),
            "first": F.min(F.when(valid, F.struct(*order, "origin"))),
            "slots": F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(sentence_nr, {n_slots}) as int))"))}


def score_cube(detailed: DataFrame, order: Sequence[str] = LOG_ORDER, n_slots: int = 1) -> DataFrame:
    """The merged log as a cube: mergeable statistics per cell and score.

    One pass makes it, and everything that is reported rolls it up: cells
    (``cells_of``), and score histograms (columns ``score`` and ``n``) for
    intervals.  ``first`` holds a cell's first valid row of that score.
    """
    return detailed.groupBy(*CELL, "score").agg(*[c.alias(name) for name, c in _counts(order, n_slots).items()])


def log_and_cube(detailed: DataFrame, order: Sequence[str] = LOG_ORDER, n_slots: int = 1) -> DataFrame:
    """The rows of the merged log and of its cube (``kind`` log, cube) from one
    pass: a window counts the rows of a cell and score, and the one with the
    least sample, which is the only one, goes out as the cube's row too."""
    counts = _counts(order, n_slots)
    same = Window.partitionBy(*CELL, "score")
    rows = detailed.select("*", *[c.over(same).alias(name) for name, c in counts.items()], F.min("sentence_nr").over(same).alias("_least"))
    kinds = F.when(F.col("sentence_nr").eqNullSafe(F.col("_least")), F.array(F.lit("log"), F.lit("cube"))).otherwise(F.array(F.lit("log")))
    rows, of_log = rows.withColumn("kind", F.explode(kinds)), F.col("kind") == "log"
    score = F.when(~of_log & (F.col("score") == 0), F.lit(0).cast(detailed.schema["score"].dataType)).otherwise(F.col("score"))  # -0.0 is 0.0 in a cube
    return rows.select(*CELL, score.alias("score"), *[F.when(of_log, F.col(c)).alias(c) for c in detailed.columns if c not in [*CELL, "score"]],
                       *[F.when(~of_log, F.col(c)).alias(c) for c in counts], "kind")


def cells_of(cube: DataFrame) -> DataFrame:
    """Cell statistics (as ``log_cells``) rolled up from a cube."""
    score = F.col("score")
    counted = score.isNotNull()
    return cube.groupBy(*CELL).agg(
        F.sum(F.when(counted, F.col("n")).otherwise(0)).alias("n"), F.sum(score * F.col("n")).alias("total"),
        F.sum(score * score * F.col("n")).alias("squares"), F.sum("n").alias("rows"), F.sum("errors").alias("errors"),
        F.sum("valid_rows").alias("valid_rows"), F.sum(F.when(counted, F.col("valid_rows")).otherwise(0)).alias("valid_n"),
        F.sum(F.when(F.col("valid_rows") > 0, score * F.col("valid_rows"))).alias("valid_total"),
        F.min("first")["origin"].alias("origin"), F.bit_or("slots").alias("slots"))


def guarded_cells(cells: DataFrame, cohort: DataFrame, cohort_languages: DataFrame,
                  min_attempts: int = K.HEALTH_MIN_ATTEMPTS, fail_pct: float = K.HEALTH_FAIL_PCT,
                  expected: DataFrame | None = None, n_slots: int = 1, by_model: bool = False) -> DataFrame:
    """Cells with ``published``: whether the guard lets them into the
    aggregate, and if so their ``score`` and ``origin`` there (G3 + G4).

    The guard is decided per model from its cells, by windows at cell grain,
    where a model has at most languages x metrics rows; so the log is read
    once.  A model passes if it is covered and hasn't ``min_attempts`` rows with
    ``fail_pct`` % errors.  With ``expected`` (task, bcp_47), covered means
    that each sample of each expected pair of the model's ``tasks`` was
    attempted; without, ``cohort`` lists the covered models.  Rows of all
    languages count for the guard.  ``by_model``: they are dealt by model
    already.
    """
    # One exchange by model serves the join and both windows.
    cells = cells if by_model else cells.repartition("model")
    model = Window.partitionBy("model")
    if expected is None:
        cells = cells.join(cohort.select("model", F.lit(True).alias("_covered")), "model", "left")
        covered = F.coalesce("_covered", F.lit(False))
    else:
        pairs = expected.select("task", "bcp_47").distinct()
        per_task = pairs.groupBy("task").agg(F.count("*").alias("_pairs"))
        asked = (cohort.select("model", "tasks", F.explode("tasks").alias("task")).join(bounded(per_task, len(K.TASKS)), "task")
                 .groupBy("model").agg(F.any_value("tasks").alias("_tasks"), F.sum("_pairs").alias("_asked")))
        listed = bounded(pairs.withColumn("_listed", F.lit(True)), len(K.TASKS) * K.N_LANGUAGES)
        cells = cells.join(asked, "model", "left").join(listed, ["task", "bcp_47"], "left")
        # A pair can have several metrics: its samples count once.
        pair = Window.partitionBy("model", "bcp_47", "task")
        whole = F.bit_or("slots").over(pair) == (1 << n_slots) - 1
        first = F.min(F.struct("metric")).over(pair) == F.struct("metric")  # of the same window, without an order
        cells = cells.withColumn("_whole", F.when(first, whole & F.col("_listed") & F.array_contains("_tasks", F.col("task"))))
        covered = F.count_if("_whole").over(model) == F.coalesce("_asked", F.lit(-1))
    total, errors = F.sum("rows").over(model), F.sum("errors").over(model)
    broken = (total >= min_attempts) & (errors / total * 100 >= fail_pct)
    cells = cells.withColumn("_passes", covered & ~broken & (F.col("valid_rows") > 0))
    known = cohort_languages.select("bcp_47", F.lit(True).alias("_known")).distinct()
    cells = cells.join(known, "bcp_47", "left")
    published = F.col("_passes") & F.coalesce("_known", F.lit(False))
    return cells.select(
        *CELL, "n", "total", "squares", published.alias("published"),
        F.when(published, F.col("valid_total") / F.col("valid_n")).alias("score"),
        F.when(published, F.col("origin")).alias("origin"))


def published_aggregate(detailed: DataFrame, cohort: DataFrame, cohort_languages: DataFrame,
                        min_attempts: int = K.HEALTH_MIN_ATTEMPTS, fail_pct: float = K.HEALTH_FAIL_PCT,
                        order: Sequence[str] = LOG_ORDER, expected: DataFrame | None = None,
                        n_slots: int = 1) -> DataFrame:
    """The published aggregate (G3 + G4) in one pass over the merged log: the
    cells that pass the guard (``guarded_cells``)."""
    cells = log_cells(detailed, order, n_slots)
    return (guarded_cells(cells, cohort, cohort_languages, min_attempts, fail_pct, expected, n_slots)
            .where("published").select(*CELL, "score", "origin"))
