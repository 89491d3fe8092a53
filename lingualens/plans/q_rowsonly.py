"""Sinks and sources: round trips, guarded publish, the dashboard payload, and
the micro-batch log (A1-A7, A9, A10, K1-K3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import health
from ..operators.bootstrap import metric_intervals
from ..operators.log import keep_last, published_aggregate
from ..session import shared_dir
from ..sources import io
from ..sources import manifest as mf
from ..streaming import incremental as inc
from . import dashboard
from .context import PUBLISH_FAIL_PCT, PUBLISH_MIN_ATTEMPTS
from .oracle import COVER_SLOTS
from .q_board import _BOARD_SELECT, _LANG_CTES, _LANG_SELECT, _O, M, SELECTED
from .q_history import _LICENSE, _SCORES, _TIER_SCORES
from .q_stats import long_ci_ctes
from .registry import query


#: Micro-batches of the streaming merge.
ARRIVALS = 3
_SEL = ", ".join(f"'{c}'" for c in SELECTED)
_HEALTH_SQL = """
SELECT model, count(*) AS total, count(*) FILTER (WHERE status IS DISTINCT FROM 'ok') AS failed,
  avg(score) FILTER (WHERE status = 'ok') AS score_nonfailed,
  count(*) FILTER (WHERE status IS DISTINCT FROM 'ok') / count(*) * 100 AS failed_pct
FROM kl GROUP BY model"""
_SEL_CELLS = f"(SELECT * FROM results_tm WHERE bcp_47 IN ({_SEL}))"
_SEL_ROWS = f"(SELECT * FROM kl_tm WHERE bcp_47 IN ({_SEL}))"
_CI = [f"{m}_ci_{e}" for m in [*M, "average"] for e in ("lower", "upper")]


def _wide_ci(name: str, group: str) -> str:
    return (f"SELECT {group}, " + ", ".join(f"max(ci_{e}) FILTER (WHERE metric = '{m}') AS {m}_ci_{e}" for m in [*M, "average"]
                                            for e in ("lower", "upper")) + f" FROM {name}_long GROUP BY {group}")


def _language_ctes(name: str, cells: str, rows: str) -> list[tuple[str, str]]:
    """The language table over given cells and rows."""
    return [(f"{name}_o", _LANG_CTES[1][1].replace("results_tm", cells)), (f"{name}_m", _LANG_CTES[0][1].replace("kl_tm", rows)),
            (f"{name}_s", f"SELECT * FROM {name}_o LEFT JOIN {name}_m USING (bcp_47)"), (name, _LANG_SELECT.replace("lsc", f"{name}_s"))]


def _values(collection: str, key: str, source: str, numbers: list[str], texts: list[str]) -> str:
    """(collection, key, field, number, text) of a table's columns, without NULLs."""
    items = [f"{{'field': '{c}', 'number': CAST({c} AS DOUBLE), 'text': CAST(NULL AS VARCHAR)}}" for c in numbers]
    items += [f"{{'field': '{c}', 'number': CAST(NULL AS DOUBLE), 'text': CAST({c} AS VARCHAR)}}" for c in texts]
    items.append("{'field': '', 'number': 1.0e0, 'text': CAST(NULL AS VARCHAR)}")
    return (f"SELECT '{collection}' AS collection, key, v.field AS field, v.number AS number, v.text AS text "
            f"FROM (SELECT {key} AS key, unnest([{', '.join(items)}]) AS v FROM {source}) WHERE v.number IS NOT NULL OR v.text IS NOT NULL")


_PAYLOAD_CTES = [
    *_TIER_SCORES, *_LICENSE,
    ("sel_sc", _SCORES[1].replace("results_tm", _SEL_CELLS)),
    *long_ci_ctes("model", "mci", _SEL_ROWS), *long_ci_ctes("bcp_47", "lci"),
    ("mt", f"""SELECT b.*, o.* EXCLUDE (model), {", ".join(_CI)} FROM ({_BOARD_SELECT.replace("FROM sc", "FROM sel_sc sc")}) b
      JOIN (SELECT model, {", ".join(f"avg(score) FILTER (WHERE task_metric_origin = '{c}') AS {c}" for c in _O)},
              {", ".join(f"coalesce(bool_or(origin = 'machine') FILTER (WHERE task_metric = '{m}'), false) AS {m}_contains_machine" for m in M)}
            FROM {_SEL_CELLS} GROUP BY model) o ON o.model = b.model
      LEFT JOIN ({_wide_ci("mci", "model")}) i ON i.model = b.model"""),
    *_language_ctes("all_lt", "results_tm", "kl_tm"), *_language_ctes("sel_lt", _SEL_CELLS, _SEL_ROWS),
    ("lang", f"SELECT a.*, {', '.join(_CI)} FROM all_lt a LEFT JOIN ({_wide_ci('lci', 'bcp_47')}) i ON i.bcp_47 = a.bcp_47"),
    ("ctry", """SELECT p.iso2, l.bcp_47, l.language_name, p.population AS language_population, l.average AS language_score,
        sum(p.population) OVER c AS population, count(*) OVER c AS n_languages,
        CASE WHEN sum(p.population) OVER c >= 1000 THEN sum(coalesce(l.average, 0) * p.population) OVER c / sum(p.population) OVER c END AS score
      FROM sel_lt l JOIN population p ON p.bcp_47 = l.bcp_47 WINDOW c AS (PARTITION BY p.iso2)"""),
    ("cat", "SELECT * REPLACE (array_to_string(tasks, ',') AS tasks) FROM dataset_catalog"),
    ("mtm", "SELECT DISTINCT task_metric FROM results_tm WHERE origin = 'machine'"),
]
_META = ["name", "provider_name", "creation_date", "type", "hf_id", "license"]
_PAYLOAD_SQL = " UNION ALL ".join([
    _values("model_table", "model", "mt", ["rank", "cost", "size", "average", *M, *_O, *_CI], [*_META, *[f"{m}_contains_machine" for m in M]]),
    _values("language_table", "bcp_47", "lang", ["speakers", "average", *M, *_CI],
            ["language_name", "autonym", "family", "in_benchmark", *[f"{m}_origin" for m in M]]),
    _values("dataset_table", "name", "cat", [], ["catalog_group", "n_languages", "translation", "tasks", "implemented"]),
    _values("countries", "iso2 || '/' || bcp_47", "ctry", ["population", "n_languages", "score", "language_population", "language_score"],
            ["language_name"]),
    _values("machine_translated_metrics", "task_metric", "mtm", [], []),
    _values("language_tier_history", "tier || '/' || model", "ts", ["proficiency_score"], ["name", "provider_name", "creation_date"]),
    _values("license_history", "model", "lh", ["proficiency_score"], ["name", "provider_name", "creation_date", "license_type"]),
])


def _scratch(ctx, name: str) -> str:
    return shared_dir(ctx.spark, f"{name}-{uuid.uuid4().hex[:12]}")


@query("table_round_trip", ["kl"], _HEALTH_SQL)
def table_round_trip(ctx):
    """The model-health table written as parquet, JSON,
    CSV and TSV in the shared folder and read back with explicit schemas;
    a missing table loads as an empty one."""
    base = _scratch(ctx, "roundtrip")
    h = health.model_health(ctx.detailed).select("model", "total", "failed", "score_nonfailed",
                                                 "failed_pct")
    io.save(h, f"{base}/health", json_path=f"{base}/health_json")
    h = io.load(ctx.spark, f"{base}/health", io.MODEL_HEALTH)  # derived once, then read
    io.write_health_snapshot(h, f"{base}/snapshot")
    h.write.mode("overwrite").option("header", True).csv(f"{base}/health_csv")
    h.write.mode("overwrite").option("sep", "\t").csv(f"{base}/health_tsv")
    back = io.load(ctx.spark, f"{base}/health", io.MODEL_HEALTH)
    missing = io.load(ctx.spark, f"{base}/does-not-exist", io.MODEL_HEALTH)
    csv = io.read_csv_na_empty_only(ctx.spark, f"{base}/health_csv", io.MODEL_HEALTH)
    tsv = io.read_tsv(ctx.spark, f"{base}/health_tsv", io.MODEL_HEALTH)
    io.save_local_only(h, f"{base}/local")
    js = ctx.spark.read.schema(io.MODEL_HEALTH).json(f"{base}/snapshot").join(
        ctx.spark.read.schema(io.MODEL_HEALTH).json(f"{base}/local").select("model"), "model", "left_semi")
    # Every reader must return the same models: join the four read-backs.
    keyed = [d.select("model", F.col("total").alias(f"total_{i}"))
             for i, d in enumerate([csv, tsv, js])]
    out = back.unionByName(missing)
    for k in keyed:
        out = out.join(k, "model")
    return out.select("model", "total", "failed", "score_nonfailed", "failed_pct")


@query("dashboard_payload", ["results_tm", "languages", "population", "dataset_catalog", "models", "kl_tm"], _PAYLOAD_SQL,
       _PAYLOAD_CTES)
def dashboard_payload(ctx):
    """A10: the seven dashboard collections for a language selection, rolled
    up from one cube and written as JSON; returns every value of the files."""
    sel = ctx.spark.range(1).select(F.explode(F.array(*map(F.lit, SELECTED))).alias("bcp_47"))
    path = _scratch(ctx, "dashboard")
    # Three collections show the models: read from the log once.
    models = _small(ctx, ctx.models, path, "models")
    payload = dashboard.build_dashboard(ctx.cube_cells, ctx.cube, models, ctx.languages,
                                        ctx.view("population"), ctx.view("dataset_catalog"), sel)
    dashboard.write_dashboard(payload, path)
    return dashboard.payload_values(ctx.spark, payload, path)


def _merged(ctx, **how):
    """Run the streaming merge over ``ARRIVALS`` micro-batches, however many
    files the log arrives in; the tables' folder."""
    base = _scratch(ctx, "stream")
    src = ctx.log.withColumn("arrival", (F.col("tie1") % ARRIVALS).cast("int"))
    src.write.mode("overwrite").partitionBy("arrival").parquet(f"{base}/incoming")
    incoming = ctx.spark.read.parquet(f"{base}/incoming")
    schema, files = incoming.schema, len(incoming.inputFiles())
    cohort, languages = _small(ctx, ctx.cohort, base, "cohort"), _small(ctx, ctx.languages, base, "languages")
    expected = _small(ctx, ctx.expected, base, "expected")
    q = inc.start_log_merge(ctx.spark, f"{base}/incoming", schema, f"{base}/merged", f"{base}/ckpt_log", cohort, languages,
                            files_per_batch=-(-files // ARRIVALS) or None, expected=expected, n_slots=COVER_SLOTS,
                            min_attempts=PUBLISH_MIN_ATTEMPTS, fail_pct=PUBLISH_FAIL_PCT, **how)
    q.awaitTermination()
    return f"{base}/merged"


def _small(ctx, df, base: str, name: str):
    """A dimension written once, so that every micro-batch reads it."""
    df.write.parquet(f"{base}/{name}")
    return ctx.spark.read.schema(df.schema).parquet(f"{base}/{name}")


@query("incremental_log", ["kl"], "SELECT * FROM kl")
def incremental_log(ctx):
    """K1: the result log arrives in three file batches; a streaming query
    merges each batch (keep-last).  Equals the batch keep-last."""
    return mf.load(ctx.spark, _merged(ctx), "log", ctx.detailed.schema)


@query("incremental_results", ["results"], "SELECT * FROM results")
def incremental_results(ctx):
    """K2: the aggregate that the same stream refreshes, through the publish
    guard.  Equals the batch aggregate."""
    return mf.load(ctx.spark, _merged(ctx), "results", ctx.results.schema)


@query("incremental_intervals", ["kl_tm"], "SELECT * FROM ci_long", long_ci_ctes("model"))
def incremental_intervals(ctx):
    """The intervals that the same stream keeps, redone for the models
    of each batch.  Equal the batch query's."""
    schema = metric_intervals(ctx.detailed, "model").schema
    return mf.load(ctx.spark, _merged(ctx, intervals={}), "intervals", schema)


@query("json_catalog", ["dataset_catalog"], """
SELECT name, translation, coalesce(TRY_CAST(n_languages AS INTEGER), -1) AS n_languages, tasks, implemented FROM dataset_catalog""")
def json_catalog(ctx):
    """The dataset catalog as one JSON array whose ``n_languages`` is a
    number in some records, text in others and null elsewhere, read with one type."""
    c = ctx.view("dataset_catalog")
    as_text = F.col("name").substr(-1, 1).cast("int") % 2 == 0
    count = F.when(F.col("n_languages").isNull(), "null").when(as_text, F.concat(F.lit('"'), "n_languages", F.lit('"'))).otherwise(F.col("n_languages"))
    rest = F.to_json(F.struct("name", "translation", "tasks", "implemented"))
    record = F.concat(F.lit('{"n_languages": '), count, F.lit(", "), F.substring(rest, F.lit(2), F.length(rest)))
    path = f"{_scratch(ctx, 'json')}/datasets.json"
    # One record a dataset source: a small file by definition.
    c.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(record), ",\n"), F.lit("\n]")).alias("value")).write.text(path)
    return io.read_json_array(ctx.spark, path).select(
        "name", "translation", F.coalesce("n_languages", F.lit(-1)).alias("n_languages"), "tasks", "implemented")


@query("published_set", ["results"], "SELECT * FROM results")
def published_set(ctx):
    """A2, A4: log, results, models and languages published as one set, part
    by part, by a writer that merges into the set it finds; the results as a
    reader of the last manifest gets them."""
    base = f"{_scratch(ctx, 'set')}/published"
    models, languages = _small(ctx, ctx.models, base, "in-models"), _small(ctx, ctx.languages, base, "in-languages")
    cohort, expected = _small(ctx, ctx.cohort, base, "in-cohort"), _small(ctx, ctx.expected, base, "in-expected")
    rows = _small(ctx, ctx.log, base, "in-log")
    for part in range(3):
        def change(held, part=part):
            new = keep_last(mf.load(ctx.spark, base, "results-detailed", rows.schema, held).unionByName(rows.where(F.col("tie1") % 3 == part)))
            new = new.select(rows.columns)
            board = lambda log: published_aggregate(
                log, cohort, languages, PUBLISH_MIN_ATTEMPTS, PUBLISH_FAIL_PCT, expected=expected, n_slots=COVER_SLOTS)
            return {"results-detailed": new, "results": board, "models": models, "languages": languages}
        mf.updated(ctx.spark, base, change)
    return mf.load(ctx.spark, base, "results", ctx.results.schema)


@query("publish_twice", ["kl"], "SELECT * FROM kl")
def publish_twice(ctx):
    """A1, A2, A4: load, merge and publish on one path, three times."""
    path = f"{_scratch(ctx, 'publish')}/results-detailed"
    out = None
    for part in range(3):
        out = io.merge_and_publish(ctx.spark, ctx.log.where(F.col("tie1") % 3 == part), path)
    return out


@query("streaming_error_rate", ["result_log"], """
SELECT model, count(*) AS rows, count(*) FILTER (WHERE status IS DISTINCT FROM 'ok') AS not_ok,
  count(*) FILTER (WHERE status IS DISTINCT FROM 'ok') / count(*) AS error_rate
FROM result_log GROUP BY model""")
def streaming_error_rate(ctx):
    """K3: running per-model row count and not-ok rate from a stateful
    streaming aggregation over the arriving result files."""
    base = _scratch(ctx, "rate")
    ctx.log.withColumn("arrival", (F.col("tie1") % 3).cast("int")) \
        .write.mode("overwrite").partitionBy("arrival").parquet(f"{base}/incoming")
    schema = ctx.spark.read.parquet(f"{base}/incoming").schema
    q = inc.start_error_rate(ctx.spark, f"{base}/incoming", schema, f"{base}/rate", f"{base}/ckpt")
    q.awaitTermination()
    return inc.current_error_rate(ctx.spark, f"{base}/rate")
