"""Weights of large counts: exact quantiles, constant memory, the SQL twin."""

import tracemalloc

import duckdb
import numpy as np
import pytest

from lingualens.operators import bootstrap as bs
from lingualens.plans.q_stats import ci_ctes

U = (np.arange(20_000) + 0.5) / 20_000


@pytest.mark.parametrize("c", [bs.EXPANDED_FROM, 250_001, 4_000_000])
def test_expansion_is_the_exact_quantile(c):
    lo, cdf = bs.poisson_cdf(c)
    exact = lo + np.searchsorted(cdf, U)
    got = bs.poisson_expanded(np.float64(c), U)
    assert np.abs(got - exact).max() <= 1 and (got != exact).mean() < 0.005


def test_moments_and_memory_at_a_trillion():
    counts, seeds = np.array([10 ** 12] * 4), np.arange(4)
    tracemalloc.start()
    w = bs._weights(counts, seeds, 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000
    x = (w - 1e12) / 1e6
    assert abs(x.mean()) < 0.08 and abs(x.std() - 1) < 0.05
    assert (w == np.floor(w)).all()


def test_normal_quantile():
    z = bs.normal_quantile(np.array([0.5, 0.975, 0.025, 1e-9, 0.9999]))
    assert np.allclose(z, [0, 1.959963985, -1.959963985, -5.997807015, 3.719016485], atol=1e-7)


def test_intervals_of_large_counts_equal_sql(spark):
    rows = [("a", 0.0, 70_000), ("a", 1.0, 130_000), ("a", 0.5, 300), ("b", 0.25, 10 ** 7), ("b", 0.75, 12), ("c", 0.1, 65_535), ("c", 0.9, 65_536)]
    d = spark.createDataFrame(rows, "g string, score double, n long")
    got = {r.g: (r.ci_lower, r.ci_upper) for r in bs.poisson_bootstrap_ci(d, "g").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (grp VARCHAR, score DOUBLE, n BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    ctes = [(k, v.replace("count(*) AS n", "sum(n)::BIGINT AS n")) if k.endswith("_bins") else (k, v) for k, v in ci_ctes("SELECT * FROM t")]
    sql = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in ctes) + " SELECT * FROM ci"
    for g, lo, hi in con.execute(sql).fetchall():
        assert got[g] == pytest.approx((lo, hi), abs=1e-9)


def test_sums_of_whole_groups_stay_in_their_task():
    """A whole group leaves its task as two numbers, and memory is that of a
    chunk however many groups there are."""
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({
        "grp": [f"g{i // 3:05d}" for i in range(6000)] + ["large"] * 5, "score": [i % 7 / 10 for i in range(6005)],
        "n": [1 + i % 4 for i in range(6005)], "seed": list(range(6005)), "_fan": [1] * 6000 + [2] * 5})
    out = list(bs._group_sums(100, 0.025, 0.975, chunk=64, block=30)([batch.slice(0, 1000), batch.slice(1000)]))
    rows = [r for b in out for r in b.to_pylist()]
    assert max(b.num_rows for b in out) <= 64
    assert [r["grp"] for r in rows if r["sw"] is None] == [f"g{i:05d}" for i in range(2000)]
    assert [(r["grp"], r["block"], len(r["sw"])) for r in rows if r["sw"]] == [("large", 0, 240), ("large", 1, 240), ("large", 2, 240), ("large", 3, 80)]
    alone = list(bs._group_sums(100, 0.025, 0.975)([batch.slice(333, 3)]))[0].to_pylist()[0]
    assert next(r for r in rows if r["grp"] == alone["grp"]) == alone


def test_weights_by_table_are_the_exact_quantile():
    """Looked-up weights equal a search of the whole CDF, at its steps too."""
    rng = np.random.default_rng(5)
    counts = np.r_[1:40, rng.integers(1, 3000, 40), bs.EXPANDED_FROM - 1, bs.EXPANDED_FROM, 1, 1]
    seeds = rng.integers(0, 2 ** 32, len(counts))
    w, tables = bs._weights(counts, seeds, 500), {}
    u = bs._uniforms(bs._hashes(seeds, 500))
    for i, c in enumerate(counts):
        if c < bs.EXPANDED_FROM:
            lo, cdf = bs.poisson_cdf(int(c))
            assert (w[i] == lo + np.searchsorted(cdf, u[i])).all()
    assert (bs._weights(counts, seeds, 500, tables) == w).all() and (bs._weights(counts[:9], seeds[:9], 500, tables) == w[:9]).all()
    for c in (1, 7, 400):
        lo, first, guide = bs._drawn(c)
        _, cdf = bs.poisson_cdf(c)
        h = np.unique(np.clip(np.r_[first - 1, first, first + 1], 0, 2 ** 32 - 1))
        assert (np.searchsorted(first, h, "right") == np.searchsorted(cdf, (h + 0.5) / 2 ** 32)).all()


def test_percentiles_equal_numpy():
    rng = np.random.default_rng(6)
    sw, swx = rng.integers(0, 2, (20, 101)).astype(float), rng.random((20, 101))
    sw[0], sw[1] = 0, 1
    sw[2, 1:] = 0
    lo, hi = bs._bounds(sw, swx, 0.025, 0.975)
    for i in range(20):
        means = (swx[i] / np.where(sw[i] > 0, sw[i], np.nan))[sw[i] > 0]
        assert (lo[i], hi[i]) == (tuple(np.quantile(means, (0.025, 0.975))) if len(means) else (None, None))


def test_samples_are_counted_once(spark):
    """The histogram and its groups' sizes share one exchange."""
    d = spark.range(1000).selectExpr("concat('g', id % 7) AS g", "id % 5 / 4.0D AS score")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans = [bs.poisson_bootstrap_ci(x, "g")._jdf.queryExecution().executedPlan().toString()
                 for x in (d, d.withColumn("n", d.score.cast("long") + 1))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert all("ReusedExchange" in p for p in plans)


def test_weights_are_drawn_in_blocks(monkeypatch):
    """However many bins come at once, their hashes are made ``DRAWN_AT_ONCE`` bins at a time; the weights are the same."""
    rng = np.random.default_rng(8)
    counts, seeds = np.r_[rng.integers(1, 200, 300), bs.EXPANDED_FROM], rng.integers(0, 2 ** 32, 301)
    alone = np.concatenate([bs._weights(counts[i:i + 1], seeds[i:i + 1], 70) for i in range(301)])
    made, hashes = [], bs._hashes
    monkeypatch.setattr(bs, "_hashes", lambda s, replicates: made.append(len(s)) or hashes(s, replicates))
    assert (bs._weights(counts, seeds, 70) == alone).all()
    assert max(made) <= bs.DRAWN_AT_ONCE and sum(made) == 301
