"""Hand-written cases, one per semantic rule (FIXTURES §5, SURVEY §1.4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lingualens import constants as K
from lingualens.operators import cohort, countries, health, history, leaderboard, log, scoring
from lingualens.operators import correlation


def test_strict_average_null_when_a_metric_is_missing(spark):
    vals = {m: 0.5 for m in K.AVERAGED_METRICS}
    full = spark.createDataFrame([vals])
    part = full.withColumn(K.AVERAGED_METRICS[-1], F.lit(None).cast("double"))
    avg = leaderboard.strict_average()
    assert full.select(avg).first()[0] == pytest.approx(0.5)
    assert part.select(avg).first()[0] is None


def test_three_meanings_of_failed(spark):
    df = spark.createDataFrame([("ok",), ("error",), (None,)], "status string")
    r = df.agg(F.count_if(log.is_valid()).alias("valid"),
               F.count_if(F.col("status") == "error").alias("publish_fail"),
               F.count_if(health.not_ok()).alias("health_fail")).first()
    assert (r.valid, r.publish_fail, r.health_fail) == (2, 1, 2)


def _health(spark, rows):
    return spark.createDataFrame(rows, "model string, total bigint, failed bigint")


def test_strike_update_cases(spark):
    # prior 0 / fail 60 %; prior 0 / fail 85 %; prior 0 / slow and failing; prior 1 / recovered
    h = _health(spark, [("a", 100, 60), ("b", 100, 85), ("c", 100, 55), ("d", 100, 10)])
    prior = spark.createDataFrame([("d", 1)], "model string, strikes int")
    slow = spark.createDataFrame([("c",)], "model string")
    out = {r.model: r.strikes for r in health.strike_update(prior, h, slow).collect()}
    assert out == {"a": 1, "b": 2, "c": 2}


def test_strike_history_equals_repeated_updates(spark):
    import random
    rnd = random.Random(7)
    rows = []
    for m in "pqrs":
        for run in range(8):
            rows.append((m, run, 100, rnd.choice([10, 55, 60, 85, 90])))
    rh = spark.createDataFrame(rows, "model string, run_nr int, total bigint, failed bigint")
    slow = spark.createDataFrame([("q",)], "model string")
    hist = {(r.model, r.run_nr): r.strikes for r in health.strike_history(rh, slow).collect()}
    prior = spark.createDataFrame([], "model string, strikes int")
    for run in range(8):
        cur = rh.where(F.col("run_nr") == run)
        upd = health.strike_update(prior, cur, slow)
        got = {r.model: r.strikes for r in upd.collect()}
        for m in "pqrs":
            assert hist[(m, run)] == got.get(m, 0), (m, run)
        prior = spark.createDataFrame([(k, v) for k, v in got.items()], "model string, strikes int")


def test_country_rules(spark):
    lt = spark.createDataFrame(
        [("a", "A", None), ("b", "B", 0.5), ("c", "C", None), ("d", "D", 0.4)],
        "bcp_47 string, language_name string, average double")
    pop = spark.createDataFrame(
        [("c", "XS", 600), ("d", "XS", 300), ("a", "YY", 2000), ("b", "YY", 2000)],
        "bcp_47 string, iso2 string, population bigint")
    out = {r.iso2: r.score for r in countries.country_scores(lt, pop).collect()}
    assert out["XS"] is None
    assert out["YY"] == pytest.approx(0.25)


def test_frontier_records(spark):
    df = spark.createDataFrame([(1, 0.2), (2, 0.1), (3, 0.2), (4, 0.5)], "k int, v double")
    out = history.record_frontier(df, "v", ["k"]).orderBy("k").collect()
    assert [r.new_record for r in out] == [True, False, False, True]
    assert [r.max_score for r in out] == [0.2, 0.2, 0.2, 0.5]


def test_tiers_by_speaker_rank(spark):
    rows = [(f"l{i:04d}", 10_000 - i) for i in range(1, 502)]
    langs = spark.createDataFrame(rows, "bcp_47 string, speakers bigint")
    t = history.language_tiers(langs)
    tiers = {}
    for r in t.collect():
        tiers.setdefault(r.speaker_rank, set()).add(r.tier)
    assert tiers[1] == {"Top 1"}
    assert tiers[2] == {"Top 2-20"}
    assert tiers[20] == {"Top 2-20", "Top 20-200"}
    assert tiers[21] == {"Top 20-200"}
    assert tiers[500] == {"Top 20-200"}
    assert 501 not in tiers


def test_number_parsing(spark):
    df = spark.createDataFrame([("1,000", "1000"), ("3.5", "35"), ("x", "7")], "a string, b string")
    score, _ = scoring.number_score(F.col("a"), F.col("b"))
    assert [r[0] for r in df.select(score).collect()] == [1.0, 1.0, 0.0]


def test_answer_tag_extraction(spark):
    df = spark.createDataFrame(
        [("no tag here",), ("<final_answer>A\nB</final_answer>",),
         ("<final_answer> C D </final_answer>",)], "r string")
    out = [r[0] for r in df.select(scoring.final_answer(F.col("r"))).collect()]
    assert out == [None, None, "C D"]


def test_think_sections_removed(spark):
    df = spark.createDataFrame([("<think>x</think> hello",), ("<think> lone",)], "r string")
    out = [r[0] for r in df.select(scoring.clean_response(F.col("r"))).collect()]
    assert out == ["hello", "lone"]


def test_topic_rule(spark):
    df = spark.createDataFrame([("sports!", "sports"), ("sports and travel", "travel")],
                               "p string, t string")
    topics = F.array(F.lit("sports"), F.lit("travel"), F.lit("music"))
    score, _ = scoring.topic_score(F.col("p"), F.col("t"), topics)
    assert [r[0] for r in df.select(score).collect()] == [1.0, 0.0]


def test_family_keys(spark):
    df = spark.createDataFrame([("openai/gpt-5.4-mini",), ("mistralai/ministral-8b-2512",),
                                ("qwen/qwen3.6-flash",), ("openai/gpt-5.5-pro",),
                                ("anthropic/claude-opus-4.7",), ("deepseek/deepseek-v4-pro",),
                                ("nvidia/nemotron-3-super-120b-a12b",),
                                ("bytedance-seed/seed-1.6-20250625",)], "slug string")
    out = [r[0] for r in df.select(cohort.family_key(F.col("slug"))).collect()]
    assert out == ["openai/gpt", "mistralai/ministral", "qwen/qwen", "openai/gpt",
                   "anthropic/claude", "deepseek/deepseek", "nvidia/nemotron",
                   "bytedance-seed/seed"]


def test_license_text(spark):
    df = spark.createDataFrame([("apache-2.0",), ("mit",), ("bsd-3-clause",)], "l string")
    out = [r[0] for r in df.select(cohort.license_text(F.col("l"))).collect()]
    assert out == ["Apache 2.0", "Mit", "Bsd 3 Clause"]


def test_pairwise_complete_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 5.0), (4.0, 4.0)], "a double, b double")
    r = correlation.task_correlation(df, ["a", "b"]).first()
    assert r.corr == pytest.approx(0.785714, abs=1e-6)


def test_keep_last_is_idempotent_and_order_free(spark):
    rows = [("t", "m", "l", "acc", 1, 0.1 * i, "human", "ok", dt.datetime(2024, 1, i % 5 + 1), i, 0, 0.0)
            for i in range(20)]
    schema = ("task string, model string, bcp_47 string, metric string, sentence_nr int, score double, "
              "origin string, status string, logged_at timestamp, tie1 bigint, tie2 bigint, tie3 double")
    df = spark.createDataFrame(rows, schema)
    once = log.keep_last(df)
    twice = log.keep_last(once.unionByName(df))
    shuffled = log.keep_last(df.repartition(7, "tie1"))
    assert once.collect() == twice.collect() == shuffled.collect()
    assert once.first().tie1 == 19  # latest date (day 5), then largest tie1


ITEMS = "doc_id long, source_rank int, bcp_47 string, subject string, item_id long"


def test_items_come_from_the_language_source(spark):
    from lingualens.operators import items as it
    rows = [(1, 0, "en", "a", 10), (2, 0, "en", "b", 11), (3, 1, "en", "a", 12), (4, 1, "fr", "a", 10), (5, 1, "fr", "b", 11),
            (6, 2, "es", "a", 10), (7, 3, "es", "a", 11), (8, 2, "fr", "c", 13)]
    d = spark.createDataFrame(rows, ITEMS)
    # categories are the first source's: "c" is none
    got = {(r.bcp_47, r.sentence_nr): (r.subject, r.doc_id) for r in it.rotating_items(d, it.source_priority(d), 4).collect()}
    assert got == {("en", 0): ("a", 1), ("fr", 0): ("a", 4), ("es", 0): ("a", 6)}
    # common ids: human sets of en and fr only
    common = it.common_items(d)
    assert sorted(r.item_id for r in common.collect()) == [10, 11]
    four = {(r.bcp_47, r.item_id): (r.doc_id, r.origin) for r in it.items_by_common_id(d, common).collect()}
    # Spanish is machine-translated, and its set of rank 2 lacks id 11
    assert four == {("en", 10): (1, "human"), ("en", 11): (2, "human"), ("fr", 10): (4, "human"), ("fr", 11): (5, "human"),
                    ("es", 10): (6, "machine")}
    # a short first source is not continued in the next one
    six = {(r.bcp_47, r.sentence_nr): (r.doc_id, r.origin) for r in it.first_source_items(d).collect()}
    assert six == {("en", 0): (1, "human"), ("en", 1): (2, "human"), ("fr", 0): (4, "human"), ("fr", 1): (5, "human"), ("es", 0): (6, "machine")}


def test_language_without_published_result_has_no_mean(spark):
    from lingualens.operators import leaderboard as lb
    cols = "model string, bcp_47 string, task string, metric string, score double, origin string"
    results = spark.createDataFrame([("m", "en", "mmlu", "accuracy", 0.5, "human")], cols)
    detailed = spark.createDataFrame([("m", "en", "mmlu", "accuracy", 1.0, "human"), ("m", "fr", "mmlu", "accuracy", 1.0, "human")], cols)
    langs = spark.createDataFrame([("en", "E", 5), ("fr", "F", 9)], "bcp_47 string, language_name string, speakers long")
    got = [(r.bcp_47, r.mmlu_accuracy) for r in lb.by_speakers(lb.language_table(results, detailed, langs)).collect()]
    assert got == [("fr", None), ("en", 1.0)]
    none = spark.createDataFrame([], "bcp_47 string")
    assert lb.select_languages(detailed, none).count() == 2 and lb.select_languages(detailed, None).count() == 2
    assert lb.select_languages(detailed, langs.where("speakers > 5")).count() == 1


def test_two_unsupported_sides_copy_the_source(spark):
    from lingualens.operators import scoring as sc
    pairs = spark.createDataFrame([("es", "pt", 0, "hola"), ("es", "en", 1, "hola"), ("en", "en", 2, "hi"), ("en", "de", 3, "hi")],
                                  "bcp_47 string, target string, sentence_nr int, source_text string")
    sup = spark.createDataFrame([("en",), ("de",)], "bcp_47 string")
    got = {r.sentence_nr: (r.action, r.prediction, r.status) for r in sc.pair_support(pairs, sup).collect()}
    assert got == {0: ("copy", "hola", "ok"), 1: ("unsupported", None, "error"), 2: ("copy", "hi", "ok"), 3: ("translate", None, None)}


def test_white_space_of_any_script(spark):
    from pyspark.sql import functions as F
    from lingualens.operators import scoring as sc
    d = spark.createDataFrame([("\u3000\u00a0A\u2003", "a\u3000b", "a b")], "x string, p string, r string")
    row = d.select(sc.strip_ws(F.col("x")).alias("x"), sc.word_tokens(F.col("p")).alias("t"), sc.no_space(F.col("p")).alias("n")).first()
    assert (row.x, row.t, row.n) == ("A", ["a", "b"], "ab")
    wer = sc.word_error_rate(d.withColumn("g", F.lit(1)), ["g"], "p", "r").first()
    assert wer.edits == 0 and wer.wer == 0


def test_checkpoint_folder_is_kept_and_never_machine_local_on_a_cluster(spark, tmp_path, monkeypatch):
    from lingualens import session
    before = spark.sparkContext.getCheckpointDir()
    session.ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() == before

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    import pytest
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_license_title_case(spark):
    from pyspark.sql import functions as F
    from lingualens.operators import cohort as co
    d = spark.createDataFrame([("gemma2b",), ("apache-2.0",), ("mit",), ("cc-by-nc-4.0",), (None,)], "l string")
    got = [r[0] for r in d.select(co.license_text(F.col("l"))).collect()]
    assert got == ["Gemma2B", "Apache 2.0", "Mit", "Cc By Nc 4.0", None]


def test_worklist_asks_all_tasks_and_languages_of_the_log(spark):
    """The pairs come from the whole log, and every model of the cohort is asked all of them."""
    from lingualens.plans import registry
    from lingualens.plans.context import Ctx
    small = "/root/testdata/sf0.001"
    pairs = {tuple(r) for r in Ctx(spark, small).log.select("task", "bcp_47").distinct().collect()}
    queries = registry.queries()
    assert {tuple(r) for r in queries["valid_task_languages"](spark, small).select("task", "bcp_47").collect()} == pairs
    cover = queries["coverage"](spark, small).collect()
    assert cover and all(r.expected == 10 * len(pairs) for r in cover)
    pending = {r.model: r.pending for r in queries["pending_counts"](spark, small).collect()}
    assert pending == {r.model: r.pending for r in cover if r.pending}
    assert queries["worklist_pending"](spark, small).count() == sum(pending.values())


def test_pending_work_of_every_model(spark):
    """The worklist has no cap on models."""
    from lingualens.plans import registry
    from lingualens.plans.context import Ctx
    medium = "/root/testdata/sf0.01"
    models = {r.id for r in Ctx(spark, medium).models.select("id").collect()}
    pending = registry.queries()["worklist_pending"](spark, medium)
    assert len(models) > K.N_MODELS and {r.model for r in pending.select("model").distinct().collect()} == models


def test_readers_of_the_cube_take_their_columns_only(spark):
    """The cube is made once, as files by column: intervals don't read the
    rows that the origins come from, and cells lie together."""
    from lingualens.operators import bootstrap as bs
    from lingualens.plans.context import Ctx
    ctx = Ctx(spark, "/root/testdata/sf0.001")
    assert ctx.cube.inputFiles() and ctx.cube_cells.inputFiles()
    plan = bs.metric_intervals(ctx.cube, "model")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "first:struct" not in plan
    assert ctx.cube.where("score IS NULL OR n < 1").count() == 0
    placed = ctx.cube.select("model", "bcp_47", "task", "metric", F.input_file_name().alias("file")).distinct()
    assert placed.count() == ctx.cube_cells.count() > 0


def test_selection_is_sent_to_the_rows(spark):
    """Rows aren't dealt by their few languages to meet a selection, however it is given."""
    from lingualens.operators import leaderboard as lb
    rows = spark.range(50).selectExpr("concat('l', id % 5) AS bcp_47", "id")
    sel = spark.createDataFrame([("l1",), ("l3",), ("l3",), (None,)], "bcp_47 string")
    chosen = lb.select_languages(rows, sel)
    assert sorted(r.id for r in chosen.collect()) == [i for i in range(50) if i % 5 in (1, 3)]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(bcp_47" not in plan
