"""Leaderboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import countries, leaderboard as lb
from .oracle import pivot_cols, strict_avg
from .q_stats import long_ci_ctes
from .registry import query

M = K.AVERAGED_METRICS
MS = sorted(M)
# A fixed request selection for the selected-language queries.
SELECTED = ["NATION_1", "NATION_4", "NATION_9", "NATION_16", "NATION_22"]
_SEL_SQL = ", ".join(f"'{c}'" for c in SELECTED)

_SCORES = ("sc", f"""
SELECT *, {strict_avg(M)} AS average FROM (
  SELECT model, {pivot_cols(M)} FROM results_tm GROUP BY model) t""")

_BOARD_SELECT = f"""
SELECT row_number() OVER (ORDER BY average DESC NULLS LAST, sc.model) AS rank,
  sc.model, m.name, m.provider_name, m.creation_date, m.type, m.cost, m.hf_id, m.size, m.license, average, {", ".join(MS)}
FROM sc LEFT JOIN models m ON m.id = sc.model"""


@query("model_leaderboard", ["results_tm", "models"], _BOARD_SELECT, [_SCORES])
def model_leaderboard(ctx):
    """H1, H2, H4, H5, H7, H8: ranked model table with metadata."""
    return lb.model_table(ctx.results, ctx.models)


@query("model_origin_pivot", ["results_tm"], f"""
SELECT model, {pivot_cols(M)},
  {",".join(f"avg(score) FILTER (WHERE task_metric_origin = '{m}_{o}') AS {m}_{o}"
            for m in M for o in lb.ORIGINS)},
  {strict_avg([f"avg(score) FILTER (WHERE task_metric = '{m}')" for m in M])} AS average
FROM results_tm GROUP BY model""")
def model_origin_pivot(ctx):
    """H3: metric means overall and split by origin, in one aggregation."""
    return lb.model_scores(ctx.results, with_origin=True)


_O = [f"{m}_{o}" for m in M for o in lb.ORIGINS]
_CI = [f"{m}_ci_{e}" for m in [*M, "average"] for e in ("lower", "upper")]


@query("full_model_table", ["results_tm", "models", "kl_tm"], f"""
SELECT b.*, {", ".join(_O)}, {", ".join(f"{m}_contains_machine" for m in M)}, {", ".join(_CI)}
FROM ({_BOARD_SELECT}) b
JOIN (SELECT model, {", ".join(f"avg(score) FILTER (WHERE task_metric_origin = '{c}') AS {c}" for c in _O)},
        {", ".join(f"coalesce(bool_or(origin = 'machine') FILTER (WHERE task_metric = '{m}'), false) AS {m}_contains_machine" for m in M)}
      FROM results_tm GROUP BY model) o ON o.model = b.model
LEFT JOIN (SELECT model, {", ".join(f"max(ci_{e}) FILTER (WHERE metric = '{m}') AS {m}_ci_{e}" for m in [*M, "average"] for e in ("lower", "upper"))}
      FROM ci_long GROUP BY model) i ON i.model = b.model""", [_SCORES, *long_ci_ctes("model")])
def full_model_table(ctx):
    """The model table with origins, flags and intervals."""
    return lb.full_model_table(ctx.cube_cells.where("published"), ctx.cube, ctx.models)


@query("machine_flags", ["results_tm"], "SELECT model, " + ", ".join(
    f"coalesce(bool_or(origin = 'machine') FILTER (WHERE task_metric = '{m}'), false) "
    f"AS {m}_contains_machine" for m in M) + " FROM results_tm GROUP BY model")
def machine_flags(ctx):
    """H6: does a model's metric include machine-translated cells."""
    return lb.machine_flags(ctx.results)


_LANG_CTES = [
    ("means", f"SELECT bcp_47, {pivot_cols(M)} FROM kl_tm GROUP BY bcp_47"),
    ("origins", "SELECT bcp_47, " + ", ".join(
        f"arg_min(origin, model) FILTER (WHERE task_metric = '{m}') AS {m}_origin" for m in M)
     + " FROM results_tm GROUP BY bcp_47"),
    ("lsc", "SELECT * FROM origins LEFT JOIN means USING (bcp_47)"),
]
_LANG_SELECT = f"""
SELECT coalesce(l.bcp_47, lsc.bcp_47) AS bcp_47, l.language_name, l.autonym, l.speakers, l.family, l.in_benchmark,
  {strict_avg(M)} AS average, {", ".join(MS)}, {", ".join(f"{m}_origin" for m in MS)}
FROM languages l FULL JOIN lsc ON l.bcp_47 = lsc.bcp_47"""


@query("language_table", ["kl_tm", "results_tm", "languages"], _LANG_SELECT, _LANG_CTES)
def language_table(ctx):
    """Language leaderboard, all-sample means, first origins, by speakers."""
    return lb.by_speakers(lb.language_board(ctx.cells, ctx.languages))


@query("selected_language_leaderboard", ["results_tm", "models"], _BOARD_SELECT, [
    ("sel", f"SELECT * FROM results_tm WHERE bcp_47 IN ({_SEL_SQL})"),
    ("sc", f"""SELECT *, {strict_avg(M)} AS average FROM (
               SELECT model, {pivot_cols(M)} FROM sel GROUP BY model) t""")])
def selected_language_leaderboard(ctx):
    """Model table restricted to a language selection."""
    sel = ctx.spark.createDataFrame([(c,) for c in SELECTED], "bcp_47 string")
    return lb.model_table(lb.select_languages(ctx.results, sel), ctx.models)


@query("machine_metrics", ["results_tm"],
       "SELECT DISTINCT task_metric FROM results_tm WHERE origin = 'machine'")
def machine_metrics(ctx):
    """Metrics with machine-translated rows."""
    return lb.machine_metrics(ctx.results)


@query("group_stats", ["kl_tm"], f"""
SELECT model, task_metric, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS std
FROM kl_tm WHERE task_metric IN ({", ".join(f"'{m}'" for m in M)}) GROUP BY model, task_metric""")
def group_stats(ctx):
    """Count, mean and sample std per model and metric."""
    return lb.group_stats(ctx.detailed, "model")


_COUNTRY_CTES = _LANG_CTES + [
    ("lt", _LANG_SELECT),
    ("cl", """SELECT p.iso2, lt.language_name AS name, lt.bcp_47, p.population, lt.average AS score
              FROM lt JOIN population p ON p.bcp_47 = lt.bcp_47"""),
]


@query("country_scores", ["kl_tm", "results_tm", "languages", "population"], """
SELECT iso2, CAST(sum(population) AS BIGINT) AS population, count(*) AS n_languages,
  CASE WHEN sum(population) < 1000 THEN NULL
       ELSE sum(coalesce(score, 0) * population) / sum(population) END AS score
FROM cl GROUP BY iso2""", _COUNTRY_CTES)
def country_scores(ctx):
    """Speaker-weighted country score, missing = 0, small countries NULL."""
    lt = lb.language_board(ctx.cells, ctx.languages)
    return countries.country_scores(lt, ctx.view("population"))


@query("country_language_list", ["kl_tm", "results_tm", "languages", "population"],
       "SELECT iso2, name, bcp_47, population, score FROM cl", _COUNTRY_CTES)
def country_language_list(ctx):
    """The nested per-country language list, exploded for comparison."""
    lt = lb.language_board(ctx.cells, ctx.languages)
    nested = countries.country_table(lt, ctx.view("population"))
    return nested.select("iso2", F.inline("languages"))
