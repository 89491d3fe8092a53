"""Properties: incremental = batch, invariance to partitioning, CI sanity."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from lingualens.operators import bootstrap as bs
from lingualens.operators import leaderboard as lb
from lingualens.operators import worklist as wl
from lingualens.plans.context import Ctx
from lingualens.sources import io

from .conftest import MEDIUM, SMALL


def test_incremental_log_equals_batch_keep_last(spark):
    inc = E.queries()["incremental_log"](spark, SMALL)
    batch = Ctx(spark, SMALL).detailed
    cols = sorted(batch.columns)
    assert inc.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    assert batch.select(*cols).exceptAll(inc.select(*cols)).count() == 0


def test_streaming_error_rate_equals_batch(spark):
    s = {r.model: (r.rows, r.not_ok) for r in E.queries()["streaming_error_rate"](spark, SMALL).collect()}
    log = Ctx(spark, SMALL).log
    b = {r.model: (r.n, r.bad) for r in log.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("status").eqNullSafe("ok")).alias("bad")).collect()}
    assert s == b


def test_worklist_minus_itself_is_empty(spark):
    ctx = Ctx(spark, SMALL)
    cohort = wl.cohort_models(ctx.models, 10)
    work = wl.worklist(cohort, wl.top_languages(ctx.languages, 10), wl.valid_task_languages(ctx.log))
    assert work.join(work, wl.WORK_KEY, "left_anti").count() == 0
    assert work.count() > 0


def test_leaderboard_invariant_to_input_partitioning(spark):
    ctx = Ctx(spark, SMALL)
    from lingualens.operators import leaderboard as lb
    a = lb.model_table(ctx.results, ctx.models)
    b = lb.model_table(ctx.results.repartition(13, "bcp_47"), ctx.models.repartition(3))
    ra = sorted(a.collect(), key=lambda r: r.rank)
    rb = sorted(b.collect(), key=lambda r: r.rank)
    assert [(r.rank, r.model) for r in ra] == [(r.rank, r.model) for r in rb]
    for x, y in zip(ra, rb):
        assert (x.average is None and y.average is None) or x.average == pytest.approx(y.average, rel=1e-12)


def test_fixture_bootstrap_values(spark):
    acc = Ctx(spark, MEDIUM).detailed.where((F.col("metric") == "accuracy") & F.col("model").isin("m1", "m2", "m3"))
    ci = bs.hashed_resample_ci(acc, "model", ["bcp_47", "task", "sentence_nr"], replicates=10)
    out = {r.model: (r.ci_lower, r.ci_upper) for r in ci.collect()}
    assert out["m1"] == pytest.approx((0.440749235, 0.506269113), abs=1e-9)
    assert out["m2"] == pytest.approx((0.493416667, 0.567000000), abs=1e-9)
    assert out["m3"] == pytest.approx((0.430923345, 0.517944251), abs=1e-9)


def test_poisson_ci_brackets_the_mean_and_is_partition_free(spark):
    ctx = Ctx(spark, SMALL)
    d = ctx.detailed.where(F.col("metric") == "accuracy")
    ci = bs.poisson_bootstrap_ci(d, "model", replicates=200)
    ci2 = bs.poisson_bootstrap_ci(d.repartition(5, "score"), "model", replicates=200)
    means = {r.model: r.m for r in d.groupBy("model").agg(F.avg("score").alias("m")).collect()}
    rows = ci.collect()
    assert sorted(rows) == sorted(ci2.collect())
    inside = sum(1 for r in rows if r.ci_lower <= means[r.model] <= r.ci_upper)
    assert all(r.ci_lower <= r.ci_upper for r in rows)
    assert inside >= 0.9 * len(rows)


def test_frontier_never_falls_along_date_and_rank(spark):
    ctx = Ctx(spark, SMALL)
    rank = {r.model: r["rank"] for r in lb.model_table(ctx.results, ctx.models).collect()}
    f = E.queries()["frontier_by_date"](spark, SMALL).collect()
    f.sort(key=lambda r: (r.creation_date is not None, r.creation_date or 0, rank[r.model]))
    assert len(f) > 2
    best = 0.0
    for r in f:
        assert r.new_record == (r.average > best)
        best = max(best, r.average)
        assert r.max_average == best


def test_bootstrap_is_the_same_however_bins_are_split(spark):
    import numpy as np
    d = Ctx(spark, SMALL).detailed.where(F.col("metric") == "bleu").select("model", "score")
    one = {r.model: (r.ci_lower, r.ci_upper) for r in bs.poisson_bootstrap_ci(d, "model").collect()}
    many = {r.model: (r.ci_lower, r.ci_upper) for r in bs.poisson_bootstrap_ci(d, "model", bins_per_salt=2).collect()}
    assert set(one) == set(many)
    assert all(one[m] == pytest.approx(many[m], rel=1e-12) for m in one)
    # against plain numpy: the same weights, summed at once
    hist = (d.where("model = 'm1'").groupBy("model", "score").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("seed", bs.bin_seed(F.col("model"), F.col("score"), 42)).toPandas())
    w = bs._weights(hist["n"].to_numpy(), hist["seed"].to_numpy(), 1000)
    sw = w.sum(0)
    means = (w * hist["score"].to_numpy()[:, None]).sum(0)[sw > 0] / sw[sw > 0]
    assert one["m1"] == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


def test_no_publish_loses_the_table_it_replaces(spark, tmp_path):
    path = str(tmp_path / "log")
    log = Ctx(spark, SMALL).log
    first = io.merge_and_publish(spark, log.where("tie1 % 2 = 0"), path)
    n = first.count()
    second = io.merge_and_publish(spark, log.where("tie1 % 2 = 1"), path)
    assert second.count() == Ctx(spark, SMALL).detailed.count() > n
    bad = second.withColumn("score", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception):
        io.save(bad, path)
    assert io.load(spark, path, second.schema).count() == second.count()


def test_guarded_publish_by_scale(spark, tmp_path):
    ctx = Ctx(spark, SMALL)
    few = spark.createDataFrame([("m1", "x")], "model string, bcp_47 string")
    many = spark.range(1000).selectExpr("cast(id as string) as model", "cast(id as string) as bcp_47")
    args = (ctx.detailed, ctx.results, ctx.models, ctx.languages)
    assert not io.guarded_publish(spark, *args, few, few, str(tmp_path / "a"), str(tmp_path / "b"))
    assert not io.path_exists(spark, str(tmp_path / "a/results"))
    assert spark.read.json(str(tmp_path / "b/models")).count() == ctx.models.count()
    assert io.guarded_publish(spark, *args, many, many, str(tmp_path / "c"), str(tmp_path / "d"))
    assert io.load(spark, str(tmp_path / "c/languages"), ctx.languages.schema).count() == ctx.languages.count()
    assert io.load(spark, str(tmp_path / "c/results-detailed"), ctx.detailed.schema).count() == ctx.detailed.count()
