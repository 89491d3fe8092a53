"""Sets published at once, and the micro-batch log: crashes, replays, two writers."""

import pytest
from pyspark.sql import functions as F

from lingualens.operators.log import keep_last, published_aggregate
from lingualens.plans.context import PUBLISH_FAIL_PCT, PUBLISH_MIN_ATTEMPTS, Ctx
from lingualens.plans.oracle import COVER_SLOTS
from lingualens.sources import io
from lingualens.sources import manifest as mf
from lingualens.streaming import incremental as inc

from .conftest import SMALL


def numbers(spark, n):
    return spark.range(n).toDF("x")


def values(df):
    return sorted(r.x for r in df.collect())


def test_failure_between_two_tables_leaves_the_old_set(spark, tmp_path):
    base = str(tmp_path)
    mf.publish({"log": numbers(spark, 3), "results": numbers(spark, 2)}, base, mf.current(spark, base))
    bad = numbers(spark, 5).withColumn("x", F.when(F.col("x") > 3, F.raise_error(F.lit("lost"))).otherwise(F.col("x")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        mf.publish({"log": numbers(spark, 9), "results": bad}, base, mf.current(spark, base))
    assert mf.current(spark, base).number == 1
    assert values(mf.load(spark, base, "log", "x long")) == [0, 1, 2]
    assert values(mf.load(spark, base, "results", "x long")) == [0, 1]
    assert mf.load(spark, base, "none", "x long").count() == 0


def test_two_writers_lose_no_rows(spark, tmp_path):
    base = str(tmp_path)
    start = mf.current(spark, base)
    mf.publish({"log": numbers(spark, 1)}, base, start)
    with pytest.raises(mf.Conflict):
        mf.publish({"log": numbers(spark, 7)}, base, start)
    held = mf.current(spark, base)
    calls = []

    def add(value, other=None):
        def change(now):
            calls.append(now.number)
            if other and len(calls) == 1:  # the other writer commits in between
                mf.updated(spark, base, add(5))
            return {"log": mf.load(spark, base, "log", "x long", now).union(spark.range(value, value + 1).toDF("x"))}
        return change

    mf.updated(spark, base, add(8, other=True))
    assert calls == [1, 1, 2] and values(mf.load(spark, base, "log", "x long")) == [0, 5, 8]
    # a reader of the older manifest still reads its own set
    assert values(mf.load(spark, base, "log", "x long", held)) == [0]


def test_claim_of_a_taken_number_conflicts(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    mf.publish({"log": numbers(spark, 1)}, base, mf.Manifest())
    # as if both had looked before either renamed
    monkeypatch.setattr(mf, "current", lambda *_: mf.Manifest())
    with pytest.raises(mf.Conflict):
        mf.publish({"log": numbers(spark, 2)}, base, mf.Manifest())
    monkeypatch.undo()
    assert values(mf.load(spark, base, "log", "x long")) == [0]


def test_sweep_keeps_what_recent_manifests_name(spark, tmp_path):
    base = str(tmp_path)
    for n in range(1, 5):
        mf.publish({"log": numbers(spark, n)}, base, mf.current(spark, base))
    assert mf.sweep(spark, base, keep=2) == 0  # too young
    assert mf.sweep(spark, base, keep=2, older_than_ms=0) == 2
    assert values(mf.load(spark, base, "log", "x long", mf.read(spark, base, 3))) == [0, 1, 2]
    assert values(mf.load(spark, base, "log", "x long")) == [0, 1, 2, 3]


def test_guarded_set_is_read_by_its_manifest(spark, tmp_path):
    one = numbers(spark, 1)
    models = spark.range(100).select(F.concat(F.lit("m"), "id").alias("model"))
    langs = spark.range(1000).select(F.concat(F.lit("l"), "id").alias("bcp_47"))
    base = str(tmp_path / "p")
    assert io.guarded_publish(spark, one, one, one, one, models, langs, base, str(tmp_path / "l"))
    assert set(mf.current(spark, base).paths) == {"results-detailed", "results", "models", "languages"}
    assert not io.guarded_publish(spark, numbers(spark, 4), one, one, one, models.limit(1), langs, base, str(tmp_path / "l"))
    assert mf.load(spark, base, "results-detailed", "x long").count() == 4 and mf.load(spark, base, "results", "x long").count() == 1


# ------------------------------------------------------------------ micro-batches

GUARD = {"min_attempts": PUBLISH_MIN_ATTEMPTS, "fail_pct": PUBLISH_FAIL_PCT, "n_slots": COVER_SLOTS}


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The log with a model that has most rows, in three arrivals, and the dimensions."""
    d = str(tmp_path_factory.mktemp("parts"))
    ctx = Ctx(spark, SMALL)
    hot = F.when(F.col("tie2") % 3 > 0, "m3").otherwise(F.col("model"))
    for name, df in {"log": ctx.log.withColumn("model", hot), "cohort": ctx.cohort, "languages": ctx.languages, "expected": ctx.expected}.items():
        df.write.parquet(f"{d}/{name}")
    read = lambda n: spark.read.parquet(f"{d}/{n}")
    log = read("log")
    return [log.where(F.col("tie1") % 3 == k) for k in range(3)], log, read("cohort"), read("languages"), read("expected")


def same(a, b):
    cols = sorted(b.columns)
    key = lambda r: tuple(map(repr, r))
    x, y = (sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.select(*cols).collect()), key=key) for d in (a, b))
    return x == y


def state(spark, base, parts, upto):
    """Whether log and aggregate are those of the first ``upto`` arrivals."""
    arrivals, log, cohort, languages, expected = parts
    merged = keep_last(arrivals[0] if upto == 1 else log.where(F.col("tie1") % 3 < upto))
    board = published_aggregate(merged, cohort, languages, expected=expected, **GUARD)
    got = mf.load(spark, base, "log", log.schema), mf.load(spark, base, "results", board.schema)
    return same(got[0], merged), same(got[1], board)


def test_merge_splits_replays_and_survives_a_crash(spark, tmp_path, parts, monkeypatch):
    arrivals, log, cohort, languages, expected = parts
    base = str(tmp_path)
    merge = lambda k: inc.merge_batch(spark, arrivals[k], k, base, cohort, languages, max_rows=300, expected=expected, **GUARD)
    first = merge(0)
    assert state(spark, base, parts, 1) == (True, True)
    assert merge(0) == first  # a replay changes nothing
    reader = mf.current(spark, base)

    def lost(*_, **__):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(mf, "commit", lost)  # after log, cells and aggregate are written
    with pytest.raises(RuntimeError, match="driver lost"):
        merge(1)
    monkeypatch.undo()
    assert state(spark, base, parts, 1) == (True, True)
    monkeypatch.setattr(inc, "guarded_cells", lost)  # between the log and the aggregate
    with pytest.raises(RuntimeError, match="driver lost"):
        merge(1)
    monkeypatch.undo()
    assert state(spark, base, parts, 1) == (True, True)
    merge(1)
    assert state(spark, base, parts, 2) == (True, True)
    merge(2)
    assert state(spark, base, parts, 3) == (True, True)

    buckets = inc.buckets_of(mf.current(spark, base).state, "log")
    assert len(buckets) > 8 and sum(2.0 ** -d for d, _, _ in buckets) == 1.0  # they cover every hash once
    holds = [p for _, _, p in buckets if p and not spark.read.parquet(f"{base}/{p}").where("model = 'm3'").isEmpty()]
    assert len(holds) > 4  # the hot model
    # who read the first manifest still reads its log
    assert mf.load(spark, base, "log", log.schema, reader).count() == keep_last(arrivals[0]).count()


def test_intervals_follow_every_batch(spark, tmp_path, parts):
    from lingualens.operators.bootstrap import metric_intervals
    arrivals, log, cohort, languages, expected = parts
    base, asked = str(tmp_path), []
    for k in range(3):
        # the second batch touches one model only
        rows = arrivals[k] if k != 1 else arrivals[1].where("model = 'm2'")
        asked.append(rows)
        before = mf.current(spark, base)
        inc.merge_batch(spark, rows, k, base, cohort, languages, max_rows=400, expected=expected, intervals={"replicates": 100}, **GUARD)
        merged = asked[0]
        for more in asked[1:]:
            merged = merged.union(more)
        want = metric_intervals(keep_last(merged), "model", replicates=100)
        got = mf.load(spark, base, "intervals", want.schema)
        assert same(got, want)
        if k == 1:
            kept = mf.load(spark, base, "intervals", want.schema, before).where("model != 'm2'")
            assert same(got.where("model != 'm2'"), kept)


def test_intervals_are_written_by_several_tasks(spark, tmp_path, parts):
    """A bucket of intervals isn't one task's; its files have models of their own."""
    arrivals, log, cohort, languages, expected = parts
    base = str(tmp_path)
    held = inc.merge_batch(spark, arrivals[0], 0, base, cohort, languages, expected=expected, intervals={"replicates": 20}, **GUARD)
    assert len(held.paths["intervals"]) == 1
    rows = spark.read.parquet(f"{base}/{held.paths['intervals'][0]}").select("model", F.input_file_name().alias("file")).distinct().collect()
    assert len({r.file for r in rows}) > 2 and len(rows) == len({r.model for r in rows})


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path, parts):
    arrivals, log, cohort, languages, expected = parts
    base = str(tmp_path)
    how = dict(max_rows=200, expected=expected, **GUARD)
    before = inc.merge_batch(spark, arrivals[0], 0, base, cohort, languages, **how)
    one = arrivals[1].where("model != 'm3'").orderBy("tie1", "tie2").limit(1)
    after = inc.merge_batch(spark, one, 1, base, cohort, languages, **how)
    for table in ("log", "cube"):
        kept = set(before.paths[table]) & set(after.paths[table])
        assert len(kept) >= len(before.paths[table]) - 1 > 1


def test_merge_takes_three_batches_however_many_files(spark, tmp_path, monkeypatch):
    """The log's files grow with the log; each batch rewrites what it touches."""
    from lingualens.plans import q_rowsonly
    from lingualens.plans.context import Ctx
    from lingualens.sources import manifest
    seen = []
    merge = q_rowsonly.inc.merge_batch
    monkeypatch.setattr(q_rowsonly.inc, "merge_batch", lambda s, b, n, *a, **k: (seen.append(n), merge(s, b, n, *a, **k))[1])
    ctx = Ctx(spark, "/root/testdata/sf0.001")
    ctx.log = ctx.log.repartition(16)
    base = q_rowsonly._merged(ctx)
    assert seen == [0, 1, 2]
    got = manifest.load(spark, base, "log", ctx.detailed.schema)
    assert got.count() == ctx.detailed.count() and got.exceptAll(ctx.detailed).count() == 0


def test_a_bucket_is_merged_and_written_by_several_tasks(spark, tmp_path, parts, monkeypatch):
    """A task's work doesn't grow with the bucket, and the log isn't dealt again for the cube."""
    import os
    monkeypatch.setattr(inc, "TASK_ROWS", 100, raising=False)
    arrivals, log, cohort, languages, expected = parts
    base = str(tmp_path)
    how = dict(expected=expected, **GUARD)
    inc.merge_batch(spark, arrivals[0], 0, base, cohort, languages, **how)
    inc.merge_batch(spark, arrivals[1], 1, base, cohort, languages, **how)
    assert state(spark, base, parts, 2) == (True, True)
    held = mf.current(spark, base)
    for table in ("log", "cube"):
        assert len(held.paths[table]) == 1
        assert len([f for f in os.listdir(f"{base}/{held.paths[table][0]}") if f.endswith(".parquet")]) > 8
    cells = [{tuple(r) for r in spark.read.parquet(f"{base}/{held.paths[t][0]}").select(*inc.CELL).distinct().collect()} for t in ("log", "cube")]
    assert cells[0] == cells[1]


def test_a_set_of_another_layout_is_dealt_anew(spark, tmp_path, parts):
    arrivals, log, cohort, languages, expected = parts
    base = str(tmp_path)
    how = dict(max_rows=300, expected=expected, **GUARD)
    first = inc.merge_batch(spark, arrivals[0], 0, base, cohort, languages, **how)
    other = {"batch": 0}  # its buckets aren't where this layout's hashes look for them
    for t in ("log", "cube", "results"):
        paths = [b[2] for b in first.state[t]]
        other[t] = [[d, e, p] for (d, e, _), p in zip(first.state[t], [*paths[1:], paths[0]])]
    mf.commit(spark, base, first, first.paths, other)
    inc.merge_batch(spark, arrivals[1], 1, base, cohort, languages, **how)
    assert state(spark, base, parts, 2) == (True, True)


def test_many_copies_of_a_key_are_combined_first(spark, tmp_path, parts, monkeypatch):
    arrivals, log, cohort, languages, expected = parts
    base, combined = str(tmp_path), []
    monkeypatch.setattr(inc, "TASK_ROWS", 500)
    merge = inc.keep_last
    monkeypatch.setattr(inc, "keep_last", lambda df: (combined.append(1), merge(df))[1])
    one = arrivals[0].orderBy("tie1", "tie2").limit(1)
    copies = one.crossJoin(spark.range(600)).withColumn("tie3", F.col("tie3") + F.col("id")).drop("id")
    rows = arrivals[0].where("model = 'm2'").unionByName(copies)
    inc.merge_batch(spark, rows, 0, base, cohort, languages, expected=expected, **GUARD)
    assert len(combined) == 2
    assert same(mf.load(spark, base, "log", log.schema), merge(rows))


def test_log_and_cube_from_one_pass(spark):
    from lingualens.operators.log import LOG_KEY, log_and_cube, score_cube
    names = [*LOG_KEY, "score", "origin", "status", "logged_at", "tie1", "tie2", "tie3"]
    rows = [("m", "a", "t", "x", nr, score, origin, status, day, 1, 1, 1.0) for nr, score, origin, status, day in [
        (1, 0.0, "human", "ok", 3), (2, -0.0, "machine", None, 2), (3, None, "human", "error", 1), (None, None, "human", "ok", 1),
        (4, float("nan"), "human", "ok", 5), (5, 0.5, None, "ok", 4)]]
    log = spark.createDataFrame(rows, "model string, bcp_47 string, task string, metric string, sentence_nr int, score double, "
                                      "origin string, status string, logged_at int, tie1 int, tie2 int, tie3 double").select(names)
    both, cube = log_and_cube(log, n_slots=5), score_cube(log, n_slots=5)
    shown = lambda d: sorted(repr(r) for r in d.collect())
    assert shown(both.where("kind = 'log'").select(names)) == shown(log)
    assert shown(both.where("kind = 'cube'").select(cube.columns)) == shown(cube)


def test_a_table_is_made_from_the_version_just_written(spark, tmp_path):
    """The log isn't merged a second time for its aggregate."""
    base, plans = str(tmp_path / "set"), []

    def board(log):
        plans.append(log.inputFiles())
        return log.selectExpr("count(*) AS n")
    mf.publish({"log": numbers(spark, 3), "results": board}, base, mf.current(spark, base))
    assert all("/tables/log/v-" in f for f in plans[0]) and plans[0]
    assert mf.load(spark, base, "results", "n long").first().n == 3
