"""Lazy, per-call set of the evaluation tables a query reads.

Nothing here runs a job: every attribute is a DataFrame plan built on first
use, so a query only reads the parquet columns its own plan needs.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..functions.joins import FIXED_ROWS, bounded
from ..operators import coverage, log, worklist
from ..session import shared_dir
from ..sources import views
from ..sources.tables import Tables
from .oracle import COVER_SLOTS

# Publish guard used by the registered queries: the default minimum number
# of attempts, and a 20 % error bar (FIXTURES: 50 % never triggers here).
PUBLISH_MIN_ATTEMPTS = 100
PUBLISH_FAIL_PCT = 20.0


class Ctx:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)

    def view(self, name: str) -> DataFrame:
        return views.VIEWS[name](self.t)

    @cached_property
    def log(self) -> DataFrame:
        return self.view("result_log")

    @cached_property
    def models(self) -> DataFrame:
        return self.view("models")

    @cached_property
    def languages(self) -> DataFrame:
        # One row per nation: bounded by definition, so joins broadcast it.
        return bounded(self.view("languages"), FIXED_ROWS["nation"])

    @cached_property
    def detailed(self) -> DataFrame:
        """The merged log: last row per 5-key (G1)."""
        return log.keep_last(self.log)

    @cached_property
    def valid(self) -> DataFrame:
        return log.valid_rows(self.detailed)

    @cached_property
    def cohort(self) -> DataFrame:
        """Every model with the tasks that it can do."""
        return self.view("model_tasks")

    @cached_property
    def task_languages(self) -> DataFrame:
        """(task, bcp_47) pairs with data in any sub-dataset."""
        return worklist.valid_task_languages(self.view("task_sources"))

    @cached_property
    def expected(self) -> DataFrame:
        """(task, bcp_47) pairs that coverage asks for."""
        return coverage.expected_languages(self.task_languages, self.languages)

    @cached_property
    def guard(self) -> DataFrame:
        """Coverage and publish decision of every model."""
        return coverage.guard(self.detailed, self.cohort, self.expected, COVER_SLOTS,
                              PUBLISH_MIN_ATTEMPTS, PUBLISH_FAIL_PCT)

    @cached_property
    def covered(self) -> DataFrame:
        """Models whose whole matrix was attempted."""
        return self.guard.where("covered").select("model")

    @cached_property
    def published(self) -> DataFrame:
        return self.guard.where("publishable").select("model")

    @cached_property
    def cells(self) -> DataFrame:
        """The cube: statistics of every cell, all rows and published ones,
        from one pass over the log.  Every board rolls it up."""
        return log.guarded_cells(log.log_cells(self.detailed, n_slots=COVER_SLOTS), self.cohort, self.languages,
                                 PUBLISH_MIN_ATTEMPTS, PUBLISH_FAIL_PCT, self.expected, COVER_SLOTS)

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` made once (a job), as Parquet in the shared checkpoint folder:
        every reader takes its columns only."""
        path = shared_dir(self.spark, f"{name}-{uuid.uuid4().hex[:12]}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @cached_property
    def cube(self) -> DataFrame:
        """The cube per cell and score, written once; boards with intervals
        read only this.

        The merged log, where a cell has at most its samples, goes by cell: a
        task has whole cells, and sorts them once for the cube and its files.
        """
        by_cell = self.detailed.repartition(*log.CELL)
        return self._written(log.score_cube(by_cell, n_slots=COVER_SLOTS), "cube")

    @cached_property
    def cube_cells(self) -> DataFrame:
        """``cells``, rolled up from the cube, written likewise."""
        return self._written(log.guarded_cells(log.cells_of(self.cube), self.cohort, self.languages, PUBLISH_MIN_ATTEMPTS,
                                               PUBLISH_FAIL_PCT, self.expected, COVER_SLOTS), "cells")

    @cached_property
    def results(self) -> DataFrame:
        """The published aggregate (G3 guard + G4), one pass over the log."""
        return self.cells.where("published").select(*log.CELL, "score", "origin")
