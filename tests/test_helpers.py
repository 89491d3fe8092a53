"""The distributed ordered helpers equal their single-window formulations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lingualens.functions.ordered import global_rank, nested_rank, running
from lingualens.functions.topk import top_k_per_group


def _skewed(spark):
    # One hot group holds a third of the rows.
    rows = [("hot" if i % 3 == 0 else f"g{i % 17}", i, (i * 7919) % 101 / 10.0) for i in range(3000)]
    return spark.createDataFrame(rows, "grp string, k int, v double").repartition(7)


def test_running_max_and_sum_match_windows(spark):
    df = _skewed(spark)
    w = Window.partitionBy("grp").orderBy("k")
    want = (df.withColumn("m", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    got = running(running(df, ["k"], F.col("v"), "max", "m", ["grp"], inclusive=False),
                  ["k"], F.col("v"), "sum", "s", ["grp"])
    a = {(r.grp, r.k): (r.m, round(r.s, 6)) for r in want.collect()}
    b = {(r.grp, r.k): (r.m, round(r.s, 6)) for r in got.collect()}
    assert a == b


def test_global_rank_matches_row_number(spark):
    df = _skewed(spark)
    want = df.withColumn("r", F.row_number().over(Window.orderBy(F.col("v").desc(), "k")))
    got = global_rank(df, [F.col("v").desc(), F.col("k")], out="r")
    assert {(r.k, r.r) for r in want.collect()} == {(r.k, r.r) for r in got.collect()}


def test_nested_rank_matches_row_number(spark):
    df = _skewed(spark).withColumn("coarse", (F.col("k") % 11).cast("int"))
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("coarse", "k")))
    got = nested_rank(df, ["grp"], ["coarse"], ["k"], out="r")
    assert {(r.k, r.r) for r in want.collect()} == {(r.k, r.r) for r in got.collect()}


def test_salted_top_k_matches_window(spark):
    df = _skewed(spark)
    w = Window.partitionBy("grp").orderBy(F.col("v").desc(), "k")
    want = df.withColumn("pos", F.row_number().over(w)).where("pos <= 5")
    got = top_k_per_group(df, ["grp"], [F.col("v").desc(), F.col("k")], 5, salt_buckets=8)
    assert {(r.grp, r.k, r.pos) for r in want.collect()} == {(r.grp, r.k, r.pos) for r in got.collect()}


def test_ranks_run_no_job_while_they_are_built(spark):
    from lingualens.operators import explorer, history, items, leaderboard, worklist
    from lingualens.sources import io
    results = spark.createDataFrame([("m", "en", "mmlu", "accuracy", 0.5, "human")], io.RESULTS)
    models = spark.createDataFrame([("m", "M", "p", None, "open-source", 1.0, None, None, None)],
                                   "id string, name string, provider_name string, creation_date date, type string, cost double, hf_id string, "
                                   "size double, license string")
    langs = spark.createDataFrame([("en", "English", 5)], "bcp_47 string, language_name string, speakers long")
    docs = spark.createDataFrame([(1, 0, "en", 7)], "doc_id long, source_rank int, bcp_47 string, item_id long")
    sc = spark.sparkContext
    sc.setJobGroup("building", "")
    try:
        board = leaderboard.model_table(results, models)
        tiers = history.tier_scores(results, langs, models)
        plans = [board, tiers, history.frontier_by_date(board), history.frontier_by_cost(board), history.frontier_by_group(tiers, "tier"),
                 explorer.speaker_cumulative(langs), explorer.pinned_order(langs), items.common_items(docs),
                 items.weighted_sample(langs, "speakers"), worklist.cohort_models(models)]
        assert list(sc.statusTracker().getJobIdsForGroup("building")) == []
        assert all(p.columns for p in plans)
        plans[0].collect()
        assert list(sc.statusTracker().getJobIdsForGroup("building")) != []
    finally:
        sc.setJobGroup("", "")


def test_running_with_any_order_and_null_groups(spark):
    import datetime as dt
    import random

    from lingualens.functions.ordered import Key, desc
    rnd = random.Random(4)
    rows = [(k, rnd.choice([None, "a", "b"]), rnd.choice([None, float("nan"), -1.5, 0.0, 2.5, 7.0]), rnd.choice([None, 1, 2, 3]),
             rnd.choice([None, dt.date(2020, 1, 1), dt.date(2024, 5, 5)]), rnd.choice([None, True, False]), f"s{rnd.randrange(9)}") for k in range(700)]
    d = spark.createDataFrame(rows, "k int, g string, x double, i int, d date, b boolean, s string").repartition(7)
    orders = [["x", "k"], [desc("x"), "k"], [desc("i"), F.col("d").desc(), "k"], [Key(F.col("d"), nulls_last=True), F.col("b").desc_nulls_last(), "k"],
              [F.col("s").desc(), "k"], [Key(-F.col("k"))], [F.col("b").desc(), F.col("s").asc_nulls_last(), desc("k")]]
    from lingualens.functions.ordered import _as_cols
    for order in orders:
        for groups in ([], ["g"]):
            w = Window.partitionBy(*groups).orderBy(*_as_cols(order))
            want = d.withColumn("r", F.row_number().over(w)).withColumn("m", F.max("k").over(w.rowsBetween(Window.unboundedPreceding, -1)))
            got = running(global_rank(d, order, "r", groups), order, F.col("k"), "max", "m", groups, inclusive=False, buckets=16)
            key = lambda r: r[0]
            assert sorted(((r.k, r.r, r.m) for r in got.collect()), key=key) == sorted(((r.k, r.r, r.m) for r in want.collect()), key=key)
