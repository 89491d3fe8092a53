"""Every query with oracle SQL equals DuckDB on the small fixture."""

import pytest

import __spark_entry__ as E
from scripts.oracle_check import close, rows_of

from .conftest import SMALL

SQL = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck_small, name):
    sdf = E.queries()[name](spark, SMALL).toPandas()
    ddf = duck_small.execute(SQL[name]).df()
    sc, sr = rows_of(sdf)
    dc, dr = rows_of(ddf)
    assert sc == dc
    assert len(sr) == len(dr)
    bad = [(a, b) for a, b in zip(sr, dr) if not close(a, b)]
    assert not bad, bad[:2]


def test_every_query_has_a_builder():
    assert set(SQL) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["rank", "model"]
    assert df.count() > 0
