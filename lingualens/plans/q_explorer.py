"""Explorer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import explorer as ex
from ..operators import leaderboard as lb
from ..operators.log import guarded_cells, log_cells
from .q_board import _BOARD_SELECT, _COUNTRY_CTES, _LANG_CTES, _LANG_SELECT, _SCORES
from .registry import query

M = K.AVERAGED_METRICS
_LT = _LANG_CTES + [("lt", _LANG_SELECT)]
_LT_USES = ["kl_tm", "results_tm", "languages"]
_BOARD = [_SCORES, ("board", _BOARD_SELECT)]

# Request parameters of the registered explorer queries.
MODEL_PROVIDERS = ["NATION_1", "NATION_3", "NATION_5", "NATION_7", "NATION_11", "NATION_13"]
MODEL_NAME = "supplier#0000000"
MODEL_TYPES = ["open-source", "closed-source"]
MODEL_COST = (-5.0, 30.0)
LANG_NAME = "nation_1"
LANG_FAMILIES = ["AFRICA", "ASIA", "EUROPE"]
LANG_SPEAKERS = (40_000, 80_000)
LANG_SELECTED = ["NATION_10", "NATION_12"]
SEARCH_TERM = "ion_2"
AUTONYM_TERM = "lingua 1"
MODEL_SIZE = (5e9, 60e9)
PINNED_FIXTURE = ["NATION_7", "NATION_3", "NATION_21", "NOT_A_CODE", "NATION_0"]
CATALOG_TASKS = ["mmlu", "arc"]
CATALOG_TRANSLATION = ["human", "mixed", "machine"]
CATALOG_N_LANGUAGES = (2, 4)


def _lt(ctx):
    return lb.language_board(ctx.cells, ctx.languages)


def _sql_list(xs):
    return ", ".join(f"'{x}'" for x in xs)


@query("speaker_cumulative", _LT_USES, """
SELECT * FROM (
  SELECT bcp_47, language_name, speakers, rank,
    sum(speakers) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum_speakers,
    sum(speakers) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) / (SELECT sum(speakers) FROM lt) AS cum_share
  FROM (SELECT *, row_number() OVER (ORDER BY speakers DESC NULLS LAST, bcp_47) AS rank FROM lt) r
) WHERE rank <= 100""", _LT)
def speaker_cumulative(ctx):
    """Cumulative speaker share of the 100 largest languages."""
    out = ex.speaker_cumulative(_lt(ctx))
    return out.withColumn("cum_speakers", F.col("cum_speakers").cast("bigint"))


@query("positive_languages", _LT_USES, """
SELECT bcp_47, language_name, speakers, average, speakers > 100000000 AS show_label
FROM lt WHERE average > 0""", _LT)
def positive_languages(ctx):
    """Languages with a positive average."""
    return ex.positive_languages(_lt(ctx))


@query("country_top_languages", _LT_USES + ["population"], """
SELECT * FROM (
  SELECT iso2, name, bcp_47, population, score,
    population / sum(population) OVER (PARTITION BY iso2) AS share,
    CAST(row_number() OVER (PARTITION BY iso2 ORDER BY population DESC, bcp_47) AS INTEGER) AS pos
  FROM cl) WHERE pos <= 10""", _COUNTRY_CTES)
def country_top_languages(ctx):
    """Ten largest languages per country with population share."""
    from ..operators.countries import _country_rows
    rows = _country_rows(_lt(ctx), ctx.view("population"))
    return ex.country_top_languages(rows.select("iso2", "name", "bcp_47", "population", "score"))


@query("evaluated_language_count", _LT_USES, f"""
SELECT count(*) FILTER (WHERE coalesce({", ".join(M)}) IS NOT NULL) AS evaluated_languages,
  count(*) AS all_languages FROM lt""", _LT)
def evaluated_language_count(ctx):
    """Languages with any metric."""
    return ex.evaluated_language_count(lb.language_board(ctx.cells, ctx.languages, shown=ex.EVALUATED_METRICS))


#: One model's science rows, and truthfulness rows for every third language.
_SPARSE = [("few", "SELECT bcp_47 FROM kl WHERE model = 'm1' AND task = 'arc' AND status IS DISTINCT FROM 'error'"),
           ("truthful", "SELECT DISTINCT l.bcp_47 FROM events e JOIN languages l ON l.bcp_47 = 'NATION_' || CAST(e.event_id % 8 * 3 AS VARCHAR)")]


@query("evaluated_by_any_metric", ["kl", "languages"], """
SELECT (SELECT count(DISTINCT bcp_47) FROM (SELECT * FROM few UNION ALL SELECT * FROM truthful)) AS evaluated_languages,
  (SELECT count(*) FROM languages) AS all_languages""", _SPARSE)
def evaluated_by_any_metric(ctx):
    """Of a sparse log, in which some languages only have truthfulness
    rows, the languages with any of the seven metrics."""
    few = ctx.detailed.where("model = 'm1' AND task = 'arc'")
    e = ctx.t.events.select("event_id", "value")
    named = {"model": F.lit("m1"), "bcp_47": F.concat(F.lit("NATION_"), (F.col("event_id") % 8 * 3).cast("string")),
             "task": F.lit("truthfulqa"), "metric": F.lit("accuracy"), "sentence_nr": (F.col("event_id") % 5).cast("int"),
             "score": F.lit(1.0), "origin": F.lit("human"), "status": F.lit("ok")}
    truthful = e.select(*[c.alias(k) for k, c in named.items()])
    both = few.unionByName(truthful, allowMissingColumns=True)
    models = both.select("model").distinct()
    cells = guarded_cells(log_cells(both), models, ctx.languages)
    return ex.evaluated_language_count(lb.language_board(cells, ctx.languages, shown=ex.EVALUATED_METRICS))


@query("model_filter", ["results_tm", "models"], f"""
SELECT * FROM board WHERE provider_name IN ({_sql_list(MODEL_PROVIDERS)})
  AND contains(lower(name), '{MODEL_NAME}') AND type IN ({_sql_list(MODEL_TYPES)})
  AND cost BETWEEN {MODEL_COST[0]} AND {MODEL_COST[1]}""", _BOARD)
def model_filter(ctx):
    """Provider / name / type / cost filters on the model table."""
    board = lb.model_table(ctx.results, ctx.models)
    return ex.model_filter(board, MODEL_PROVIDERS, MODEL_NAME, MODEL_TYPES, cost=MODEL_COST)


@query("model_filter_size", ["results_tm", "models"], f"""
SELECT * FROM board WHERE size BETWEEN {MODEL_SIZE[0]} AND {MODEL_SIZE[1]}""", _BOARD)
def model_filter_size(ctx):
    """Size filter on the model table; models of unknown size drop out."""
    return ex.model_filter(lb.model_table(ctx.results, ctx.models), size=MODEL_SIZE)


@query("language_filter", _LT_USES, f"""
SELECT * FROM lt WHERE contains(lower(language_name), '{LANG_NAME}')
  AND family IN ({_sql_list(LANG_FAMILIES)}) AND speakers BETWEEN {LANG_SPEAKERS[0]} AND {LANG_SPEAKERS[1]}
  AND bcp_47 NOT IN ({_sql_list(LANG_SELECTED)})""", _LT)
def language_filter(ctx):
    """Name / family / speakers filters, selected languages excluded."""
    sel = ctx.spark.createDataFrame([(c,) for c in LANG_SELECTED], "bcp_47 string")
    return ex.language_filter(_lt(ctx), LANG_NAME, LANG_FAMILIES, LANG_SPEAKERS, sel)


@query("filter_values", _LT_USES + ["results_tm", "models"], """
SELECT DISTINCT 'provider' AS kind, provider_name AS value FROM board WHERE provider_name IS NOT NULL
UNION ALL
SELECT * FROM (SELECT 'family' AS kind, family AS value FROM lt GROUP BY family
               ORDER BY min((-speakers, bcp_47)) LIMIT 10)
UNION ALL SELECT 'family', 'Other'""", _LT + _BOARD)
def filter_values(ctx):
    """I16: provider choices and first ten families plus 'Other'."""
    return ex.filter_values(lb.model_table(ctx.results, ctx.models), _lt(ctx))


@query("language_search", _LT_USES, f"""
SELECT * FROM lt WHERE contains(lower(language_name), '{SEARCH_TERM}') OR contains(lower(bcp_47), '{SEARCH_TERM}')
  OR contains(lower(autonym), '{SEARCH_TERM}')
ORDER BY speakers DESC NULLS LAST, bcp_47 LIMIT 20""", _LT)
def language_search(ctx):
    """Case-insensitive language search, at most 20 hits."""
    return ex.language_search(_lt(ctx), SEARCH_TERM)


@query("language_search_autonym", _LT_USES, f"""
SELECT * FROM lt WHERE contains(lower(language_name), '{AUTONYM_TERM}') OR contains(lower(bcp_47), '{AUTONYM_TERM}')
  OR contains(lower(autonym), '{AUTONYM_TERM}')
ORDER BY speakers DESC NULLS LAST, bcp_47 LIMIT 20""", _LT)
def language_search_autonym(ctx):
    """The same search, with a term that only autonyms have."""
    return ex.language_search(_lt(ctx), AUTONYM_TERM.upper())


@query("pinned_order", ["languages"], f"""
SELECT bcp_47, language_name, row_number() OVER (
  ORDER BY CASE WHEN list_position([{_sql_list(PINNED_FIXTURE)}], bcp_47) > 0
                THEN list_position([{_sql_list(PINNED_FIXTURE)}], bcp_47) END NULLS LAST,
           language_name, bcp_47) AS position
FROM languages""")
def pinned_order(ctx):
    """Pinned codes first in list order, then by name."""
    return ex.pinned_order(ctx.languages, PINNED_FIXTURE)


@query("catalog_filter", ["dataset_catalog"], f"""
SELECT name, catalog_group, TRY_CAST(n_languages AS INTEGER) AS n_languages, translation, tasks, implemented
FROM dataset_catalog
WHERE translation IN ({_sql_list(CATALOG_TRANSLATION)})
  AND TRY_CAST(n_languages AS INTEGER) BETWEEN {CATALOG_N_LANGUAGES[0]} AND {CATALOG_N_LANGUAGES[1]}
  AND list_has_any(tasks, [{_sql_list(CATALOG_TASKS)}])""")
def catalog_filter(ctx):
    """Dataset catalog filters on tasks, translation kind and size."""
    return ex.catalog_filter(ctx.view("dataset_catalog"), CATALOG_TASKS, CATALOG_TRANSLATION,
                             CATALOG_N_LANGUAGES)


@query("catalog_groups", ["dataset_catalog"], """
SELECT catalog_group, name, TRY_CAST(n_languages AS DOUBLE) AS n_languages, count(*) OVER (PARTITION BY catalog_group) AS group_size,
  CAST(row_number() OVER (PARTITION BY catalog_group ORDER BY TRY_CAST(n_languages AS INTEGER) DESC NULLS LAST, name) AS INTEGER) AS pos
FROM dataset_catalog""")
def catalog_groups(ctx):
    """Catalog rows within their group, most languages first."""
    return ex.catalog_groups(ctx.view("dataset_catalog"))


@query("catalog_tasks", ["dataset_catalog"],
       "SELECT DISTINCT unnest(tasks) AS task FROM dataset_catalog")
def catalog_tasks(ctx):
    """Distinct tasks of the catalog."""
    return ex.catalog_tasks(ctx.view("dataset_catalog"))


@query("sorted_table", _LT_USES, "SELECT * FROM lt ORDER BY average DESC NULLS LAST", _LT)
def sorted_table(ctx):
    """Language table sorted by average."""
    return ex.sorted_table(_lt(ctx), "average")
