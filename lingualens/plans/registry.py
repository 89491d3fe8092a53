"""Registry of named queries: a Spark builder and (where SQL can say it) the
equivalent DuckDB SQL used as the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .context import Ctx

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def query(name: str, uses: list[str] | None = None, sql: str | None = None,
          ctes: list[tuple[str, str]] = (), recursive: bool = False):
    """Register ``fn(ctx) -> DataFrame`` as query ``name``.

    ``uses``/``ctes``/``sql`` give the oracle SQL; omit ``sql`` for a
    rows-only check.
    """
    def deco(fn: Callable[[Ctx], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Ctx(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = oracle.build(uses or [], sql, list(ctes), recursive)
        return fn
    return deco


def _load_all():
    # Importing the modules registers their queries.
    from . import (q_board, q_cohort, q_explorer, q_history, q_items,  # noqa: F401
                   q_languages, q_log, q_scoring, q_stats, q_worklist, q_rowsonly)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)
