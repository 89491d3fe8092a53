"""History and frontier queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import history as hist
from ..operators import leaderboard as lb
from .oracle import pivot_cols, strict_avg
from .q_board import _BOARD_SELECT, _SCORES
from .registry import query

M = K.AVERAGED_METRICS
MS = sorted(M)
# End point of the step lines ("today" of the report), passed in, never now().
AS_OF = dt.date(1999, 1, 1)

_MLS = ("mls", f"""SELECT *, {strict_avg(M)} AS proficiency_score FROM (
  SELECT model, bcp_47, {pivot_cols(M)} FROM results_tm GROUP BY model, bcp_47) t""")
_TIERS = [
    ("ranked", """SELECT bcp_47, speakers,
        row_number() OVER (ORDER BY speakers DESC NULLS LAST, bcp_47) AS speaker_rank
      FROM languages"""),
    ("tiers", "SELECT * FROM (VALUES " + ", ".join(
        f"('{t}', {lo}, {hi})" for t, lo, hi in K.TIERS) + ") v(tier, lo, hi)"),
    ("lt", """SELECT r.bcp_47, r.speakers, r.speaker_rank, t.tier
      FROM ranked r JOIN tiers t ON r.speaker_rank BETWEEN t.lo AND t.hi"""),
]
_TIER_SCORES = _TIERS + [_MLS, ("ts", """
  SELECT p.model, m.name, m.provider_name, m.creation_date, p.tier, p.proficiency_score
  FROM (SELECT model, tier, avg(proficiency_score) AS proficiency_score
        FROM mls JOIN lt USING (bcp_47) GROUP BY model, tier) p
  LEFT JOIN models m ON m.id = p.model""")]
_LICENSE = [_SCORES, ("lh", """
  SELECT sc.model, m.name, m.provider_name, m.creation_date,
    CASE WHEN m.type IS NOT DISTINCT FROM 'open-source' THEN 'Open-source' ELSE 'Commercial' END AS license_type,
    sc.average AS proficiency_score
  FROM sc LEFT JOIN models m ON m.id = sc.model""")]


def _group_frontier_sql(src: str, group: str) -> str:
    return f"""
SELECT {group}, model, creation_date, proficiency_score,
  greatest(prev, proficiency_score) AS max_score, proficiency_score > prev AS new_record
FROM (SELECT *, coalesce(max(proficiency_score) OVER (PARTITION BY {group}
        ORDER BY creation_date, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
      FROM {src} WHERE proficiency_score IS NOT NULL AND creation_date IS NOT NULL) f"""


@query("model_language_scores", ["results_tm"], "SELECT * FROM mls", [_MLS])
def model_language_scores(ctx):
    """Model x language strict scores."""
    return hist.model_language_scores(ctx.results)


@query("language_tiers", ["languages"], "SELECT * FROM lt", _TIERS)
def language_tiers(ctx):
    """Speaker rank and tier per language (range join on rank)."""
    return hist.language_tiers(ctx.languages)


@query("tier_scores", ["results_tm", "languages", "models"], "SELECT * FROM ts", _TIER_SCORES)
def tier_scores(ctx):
    """Mean proficiency per model and tier."""
    return hist.tier_scores(ctx.results, ctx.languages, ctx.models)


@query("license_history", ["results_tm", "models"], "SELECT * FROM lh", _LICENSE)
def license_history(ctx):
    """I4: proficiency with license class."""
    return hist.license_history(ctx.results, ctx.models)


@query("frontier_by_date", ["results_tm", "models"], """
SELECT model, creation_date, average, greatest(prev, average) AS max_average, average > prev AS new_record
FROM (SELECT *, coalesce(max(average) OVER (ORDER BY creation_date ASC NULLS FIRST, rank
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
      FROM board WHERE average IS NOT NULL) f""", [_SCORES, ("board", _BOARD_SELECT)])
def frontier_by_date(ctx):
    """Record average over release date."""
    return hist.frontier_by_date(lb.model_table(ctx.results, ctx.models))


@query("frontier_by_cost", ["results_tm", "models"], """
SELECT model, cost, average, greatest(prev, average) AS max_average, average > prev AS new_record
FROM (SELECT *, coalesce(max(average) OVER (ORDER BY cost, rank
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
      FROM board WHERE average IS NOT NULL AND cost > 0) f""", [_SCORES, ("board", _BOARD_SELECT)])
def frontier_by_cost(ctx):
    """Record average over cost."""
    return hist.frontier_by_cost(lb.model_table(ctx.results, ctx.models))


@query("frontier_by_tier", ["results_tm", "languages", "models"],
       _group_frontier_sql("ts", "tier"), _TIER_SCORES)
def frontier_by_tier(ctx):
    """Record proficiency over date per language tier."""
    return hist.frontier_by_group(hist.tier_scores(ctx.results, ctx.languages, ctx.models), "tier")


@query("frontier_by_license", ["results_tm", "models"],
       _group_frontier_sql("lh", "license_type"), _LICENSE)
def frontier_by_license(ctx):
    """I8: record proficiency over date per license class."""
    return hist.frontier_by_group(hist.license_history(ctx.results, ctx.models), "license_type")


@query("frontier_steps", ["results_tm", "models"], f"""
SELECT license_type, creation_date AS x, max_score AS y FROM fl WHERE new_record
UNION ALL
SELECT license_type, DATE '{AS_OF.isoformat()}' AS x, max(max_score) AS y FROM fl WHERE new_record
GROUP BY license_type""", _LICENSE + [("fl", _group_frontier_sql("lh", "license_type"))])
def frontier_steps(ctx):
    """Step lines of the license frontiers with an end point at the report date."""
    f = hist.frontier_by_group(hist.license_history(ctx.results, ctx.models), "license_type")
    return hist.frontier_steps(f, "license_type", AS_OF)


_DATE_FRONTIER = ("fd", """SELECT model, creation_date, greatest(prev, average) AS max_average, average > prev AS new_record
FROM (SELECT *, coalesce(max(average) OVER (ORDER BY creation_date ASC NULLS FIRST, rank
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM board WHERE average IS NOT NULL) f""")
_COST_FRONTIER = ("fc", """SELECT model, cost, greatest(prev, average) AS max_average, average > prev AS new_record
FROM (SELECT *, coalesce(max(average) OVER (ORDER BY cost, rank
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM board WHERE average IS NOT NULL AND cost > 0) f""")


@query("frontier_steps_by_date", ["results_tm", "models"], f"""
SELECT creation_date AS x, max_average AS y FROM fd WHERE new_record
UNION ALL SELECT DATE '{AS_OF.isoformat()}', max(max_average) FROM fd WHERE new_record HAVING count(*) > 0""",
       [_SCORES, ("board", _BOARD_SELECT), _DATE_FRONTIER])
def frontier_steps_by_date(ctx):
    """Step line of the record over date, to the report date."""
    return hist.frontier_steps(hist.frontier_by_date(lb.model_table(ctx.results, ctx.models)), None, AS_OF, y="max_average")


@query("frontier_steps_by_cost", ["results_tm", "models"], """
SELECT cost AS x, max_average AS y FROM fc WHERE new_record
UNION ALL SELECT (SELECT max(cost) FROM models), max(max_average) FROM fc WHERE new_record HAVING count(*) > 0""",
       [_SCORES, ("board", _BOARD_SELECT), _COST_FRONTIER])
def frontier_steps_by_cost(ctx):
    """Step line of the record over cost, to the dearest model."""
    f = hist.frontier_by_cost(lb.model_table(ctx.results, ctx.models))
    return hist.frontier_steps(f, None, ctx.models.agg(F.max("cost")).scalar(), x="cost", y="max_average")


@query("frontier_steps_by_tier", ["results_tm", "languages", "models"], f"""
SELECT tier, creation_date AS x, max_score AS y FROM ft WHERE new_record
UNION ALL SELECT tier, DATE '{AS_OF.isoformat()}', max(max_score) FROM ft WHERE new_record GROUP BY tier""",
       _TIER_SCORES + [("ft", _group_frontier_sql("ts", "tier"))])
def frontier_steps_by_tier(ctx):
    """Step lines of the tier frontiers to the report date."""
    f = hist.frontier_by_group(hist.tier_scores(ctx.results, ctx.languages, ctx.models), "tier")
    return hist.frontier_steps(f, "tier", AS_OF)
