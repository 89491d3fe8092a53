"""Model catalog and cohort queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import cohort as co
from .q_log import _STRIKE_CTES, _history
from .registry import query

# Request parameters of the registered cohort queries.
AS_OF = dt.date(2025, 6, 30)
PROVIDERS = [f"vendor{i}" for i in range(20)]
# Curated, blocked and auto-blocked slugs are picked from the catalog by rule.
CURATED_SQL = "slug LIKE 'vendor1/%' AND slug LIKE '%.1-pro'"
BLOCKED_SQL = "slug LIKE 'vendor2/%' AND slug LIKE '%.0-mini'"
AUTO_BLOCKED_SQL = "(slug LIKE 'vendor3/%' AND slug LIKE '%-flash') OR (slug LIKE 'vendor1/%' AND slug LIKE '%.1-pro' AND slug LIKE '%-1_.%')"

_TIERS = "|".join(co.SIZE_TIER_TOKENS)
_NORM = ("norm", r"""
SELECT slug, split_part(name, ': ', 1) AS provider_name,
  regexp_replace(replace(replace(CASE WHEN instr(name, ': ') > 0 THEN substr(name, instr(name, ': ') + 2) ELSE name END,
    ' (free)', ''), ' (self-moderated)', ''), '\s*\([^)]*\)\s*$', '') AS name,
  coalesce(TRY_CAST(price_text AS DOUBLE) = 0, false) AS is_free,
  round_even(TRY_CAST(price_text AS DOUBLE) * 1000000, 2) AS cost,
  trains_on_prompts AS train_on_prompts, coalesce(CAST(repository_created AS DATE), CAST(created AS DATE)) AS creation_date
FROM catalog""")
_LOOKUP = ("lookup", """
SELECT slug, provider_name, name, is_free, cost, train_on_prompts, creation_date FROM norm
WHERE NOT is_free AND train_on_prompts = false
QUALIFY row_number() OVER (PARTITION BY slug ORDER BY name, creation_date NULLS FIRST,
  provider_name NULLS FIRST, is_free, cost NULLS FIRST, train_on_prompts) = 1""")
# The oracle's family key avoids look-ahead (not in DuckDB's regex engine):
# a version token consumes its trailing '-' and puts it back.
_FAMILY = [
    ("fk0", """SELECT slug,
      CASE WHEN instr(slug, '/') > 0 THEN split_part(slug, '/', 1) ELSE slug END AS vendor,
      CASE WHEN instr(slug, '/') > 0 THEN substr(slug, instr(slug, '/') + 1) ELSE '' END AS nm
      FROM catalog"""),
    ("fk1", r"""SELECT slug, vendor, regexp_replace(regexp_replace(regexp_replace(nm,
        '(-(20\d{6}|20\d{2}-\d{2}-\d{2}|\d{2}-\d{2}|\d{4}))+$', ''),
        '-?v?\d+(\.\d+)*(-exp|-instruct)?($|-)', '\3', 'g'),
        '-a?\d+(?:\.\d+)?x?\d*b(?:-a\d+b)?\b', '', 'g') AS stripped FROM fk0"""),
    ("fk2", f"""SELECT slug, vendor, stripped,
      regexp_replace(regexp_replace(regexp_replace(stripped, '-+', '-', 'g'), '^-|-$', '', 'g'),
        '(-({_TIERS}))+$', '') AS base FROM fk1"""),
    ("fam", """SELECT slug, CASE WHEN base <> '' THEN vendor || '/' || base
                                 ELSE vendor || '/' || stripped END AS family FROM fk2"""),
]


def _contains_any(col: str, items) -> str:
    return "(" + " OR ".join(f"contains({col}, '{x}')" for x in items) + ")"


_DISCOVERY = [_NORM, *_FAMILY,
    ("curated", f"SELECT slug FROM catalog WHERE {CURATED_SQL}"),
    ("blocked", f"SELECT slug FROM catalog WHERE {BLOCKED_SQL}"),
    ("auto_blocked", f"SELECT slug FROM catalog WHERE {AUTO_BLOCKED_SQL}"),
    ("cur_date", """SELECT f.family, max(n.creation_date) AS curated_date
       FROM norm n JOIN fam f ON f.slug = n.slug WHERE n.slug IN (SELECT slug FROM curated)
         AND n.creation_date IS NOT NULL GROUP BY f.family"""),
    ("cand", f"""SELECT DISTINCT n.slug, f.family, n.cost, n.creation_date
       FROM norm n JOIN fam f ON f.slug = n.slug
       LEFT JOIN cur_date c ON c.family = f.family
       WHERE CASE WHEN instr(n.slug, '/') > 0 THEN split_part(n.slug, '/', 1) ELSE '' END
             IN ({", ".join(f"'{p}'" for p in PROVIDERS)})
         AND NOT starts_with(n.slug, '~')
         AND NOT {_contains_any("n.slug", co.DISCOVERY_SKIP_TAGS)}
         AND NOT {_contains_any("lower(n.slug)", co.DISCOVERY_SKIP_PRODUCTS)}
         AND NOT regexp_matches(lower(n.slug), '\\d+(\\.\\d+)?v(-|$)')
         AND NOT n.is_free AND n.train_on_prompts = false
         AND n.cost IS NOT NULL AND n.cost <= {K.COST_CAP_PER_1M}
         AND n.creation_date IS NOT NULL
         AND n.creation_date >= DATE '{AS_OF.isoformat()}' - INTERVAL {K.DISCOVERY_WINDOW_DAYS} DAY
         AND n.slug NOT IN (SELECT slug FROM blocked UNION ALL SELECT slug FROM auto_blocked)
         AND (c.curated_date IS NULL OR n.creation_date > c.curated_date)
         AND f.family NOT IN (SELECT f2.family FROM fam f2 WHERE f2.slug IN (SELECT slug FROM blocked))"""),
    ("flag", """SELECT family, arg_min(slug, (-cost, -(creation_date - DATE '1970-01-01'), slug)) AS slug
       FROM cand GROUP BY family"""),
]


def _lists(ctx):
    cat = ctx.view("catalog")
    return (cat.where(CURATED_SQL).select("slug"), cat.where(BLOCKED_SQL).select("slug"),
            cat.where(AUTO_BLOCKED_SQL).select("slug"))


def _candidates(ctx):
    curated, blocked, auto = _lists(ctx)
    norm = co.normalise_catalog(ctx.view("catalog"))
    return co.discovery_candidates(norm, curated, blocked, auto, AS_OF, PROVIDERS)


def _cohort(ctx):
    curated, blocked, auto = _lists(ctx)
    flags = co.flagship_per_family(_candidates(ctx))
    ids = co.cohort_ids(curated, flags, auto, blocked)
    lookup = co.lookup_rows(co.normalise_catalog(ctx.view("catalog")))
    return co.validated_models(ids, lookup)


@query("catalog_clean", ["catalog"], f"""
SELECT * FROM lookup WHERE cost <= {K.COST_CAP_PER_1M}""", [_NORM, _LOOKUP])
def catalog_clean(ctx):
    """Typed, usable, capped catalog rows."""
    lookup = co.lookup_rows(co.normalise_catalog(ctx.view("catalog")))
    return co.cost_capped(lookup)


def _entries(ctx):
    """The catalog as JSON entries: some with a permanent slug and a hub id,
    some without a name."""
    c = ctx.view("catalog")
    pro = F.col("slug").endswith("-pro")
    return c.select(F.to_json(F.struct(
        F.col("slug").alias("id"), F.when(pro, F.concat("slug", F.lit("-v1"))).alias("canonical_slug"),
        F.when(F.col("slug").endswith("-mini"), F.lit("")).otherwise(F.col("name")).alias("name"),
        F.unix_timestamp(F.col("created").cast("timestamp")).alias("created"),
        F.when(~pro, F.lower("slug")).alias("hugging_face_id"),
        F.struct(F.col("price_text").alias("completion")).alias("pricing"))).alias("entry"))


_NESTED = ("nested", """SELECT slug, CASE WHEN ends_with(slug, '-pro') THEN slug || '-v1' ELSE slug END AS permaslug,
    CASE WHEN ends_with(slug, '-mini') THEN slug ELSE substr(name, instr(name, ': ') + 2) END AS short_name,
    CASE WHEN ends_with(slug, '-mini') THEN slug ELSE name END AS name, CAST(created AS TIMESTAMP) AS created_at,
    CASE WHEN NOT ends_with(slug, '-pro') THEN lower(slug) END AS hf_slug,
    coalesce(TRY_CAST(price_text AS DOUBLE) = 0, false) AS is_free, price_text AS completion FROM catalog""")


@query("catalog_nested", ["catalog"], "SELECT * EXCLUDE (completion) FROM nested", [_NESTED])
def catalog_nested(ctx):
    """Catalog entries from nested JSON."""
    return co.normalise_nested(_entries(ctx)).drop("completion")


@query("catalog_by_slug", ["catalog"], """
SELECT w.id, min(n.slug) AS slug FROM (SELECT DISTINCT slug || CASE WHEN ends_with(slug, '-pro') THEN '-v1' ELSE '' END AS id FROM catalog) w
JOIN nested n ON (n.slug = w.id OR n.permaslug = w.id) AND NOT n.is_free GROUP BY w.id""", [_NESTED])
def catalog_by_slug(ctx):
    """Paid entries by slug or permanent slug."""
    slug = F.col("slug")
    wanted = ctx.view("catalog").select(F.concat(slug, F.when(slug.endswith("-pro"), "-v1").otherwise("")).alias("id"))
    return co.lookup_by_slug(co.normalise_nested(_entries(ctx)), wanted).select("id", "slug")


@query("family_keys", ["catalog"], "SELECT * FROM fam", _FAMILY)
def family_keys(ctx):
    """Family key per catalog slug."""
    return ctx.view("catalog").select("slug", co.family_key(F.col("slug")).alias("family"))


@query("discovery_candidates", ["catalog"], "SELECT * FROM cand", _DISCOVERY)
def discovery_candidates(ctx):
    """Catalog rows passing the discovery rules."""
    return _candidates(ctx)


@query("flagship_per_family", ["catalog"], "SELECT * FROM flag", _DISCOVERY)
def flagship_per_family(ctx):
    """One flagship slug per family."""
    return co.flagship_per_family(_candidates(ctx))


_COHORT = _DISCOVERY + [_LOOKUP,
    ("ids", """SELECT slug FROM (SELECT slug FROM curated UNION
                 (SELECT slug FROM flag EXCEPT SELECT slug FROM auto_blocked))
               EXCEPT SELECT slug FROM blocked"""),
    ("coh", f"""SELECT l.slug AS id, l.provider_name, l.name, l.is_free, l.cost, l.train_on_prompts,
                  l.creation_date,
                  l.slug IN (SELECT slug FROM curated INTERSECT SELECT slug FROM auto_blocked) AS override
               FROM lookup l WHERE l.slug IN (SELECT slug FROM ids) AND l.cost <= {K.COST_CAP_PER_1M}"""),
]


@query("cohort", ["catalog"], "SELECT * FROM coh", _COHORT)
def cohort(ctx):
    """Cohort set algebra, validated against the catalog."""
    return _cohort(ctx)


@query("model_tasks", ["catalog"], "SELECT id, name, provider_name, cost, train_on_prompts, "
       "[" + ", ".join(f"'{t}'" for t in K.TASKS) + "] AS tasks FROM coh "
       "UNION ALL SELECT '" + K.TRANSLATION_MODEL["id"] + "', '" + K.TRANSLATION_MODEL["name"]
       + "', '" + K.TRANSLATION_MODEL["provider_name"] + "', " + str(float(K.TRANSLATION_MODEL["cost"]))
       + ", false, [" + ", ".join(f"'{t}'" for t in K.TRANSLATION_TASKS) + "]", _COHORT)
def model_tasks(ctx):
    """Task list per cohort model plus the translation model."""
    m = co.with_tasks(_cohort(ctx).select("id", "name", "provider_name", "cost", "train_on_prompts"))
    return m.select("id", "name", "provider_name", "cost", "train_on_prompts", "tasks")


@query("auto_excluded", ["run_health", "timings"], """
SELECT model, CAST(strikes AS INTEGER) AS strikes FROM rec WHERE run_nr = 9 AND strikes >= 2""",
       _STRIKE_CTES, recursive=True)
def auto_excluded(ctx):
    """Models excluded after two or more consecutive bad runs."""
    last = _history(ctx).where(F.col("run_nr") == 9)
    return co.auto_excluded(last)


_RAW_LICENSE = """CASE p_partkey % 4 WHEN 0 THEN 'mit' WHEN 1 THEN 'apache-2.0' WHEN 2 THEN 'cc-by-nc-' || lower(p_brand)
  ELSE lower(p_type) || '2b-licence' END"""


@query("license_names", [], f"""
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]+'),
  lambda w: upper(w[1:1]) || lower(w[2:])), '') AS license
FROM (SELECT p_partkey, replace(replace({_RAW_LICENSE}, '-', ' '), 'mit', 'MIT') AS x FROM part)""")
def license_names(ctx):
    """Repository licenses as display text."""
    p = ctx.t.part.select("p_partkey", F.expr(_RAW_LICENSE).alias("raw"))
    return p.select("p_partkey", co.license_text(F.col("raw")).alias("license"))


@query("cost_cap_report", ["catalog"], f"""
SELECT l.slug, l.name, l.cost FROM lookup l
WHERE l.cost > {K.COST_CAP_PER_1M} AND l.slug IN (SELECT slug FROM curated)""", _COHORT)
def cost_cap_report(ctx):
    """C14 report: curated models the cost cap drops."""
    curated, _, _ = _lists(ctx)
    lookup = co.lookup_rows(co.normalise_catalog(ctx.view("catalog")))
    return co.dropped_by_cap(lookup, curated).select("slug", "name", "cost")

