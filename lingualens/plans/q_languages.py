"""Language dimension queries.

The inputs of the language build (population keys, names, script variants,
script names, speech locales, languoids) are derived from the driver's
nation/region/customer tables by the rules below, so the work grows with
them; SQL states the same rules for the oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import languages as L
from .registry import query


def _cap4(c):
    return F.initcap(F.lower(F.substring(c, 1, 4)))


def _inputs(ctx):
    langs = ctx.languages
    pop = ctx.view("population")
    cc = F.upper(F.substring("iso2", 1, 2))
    keys = (langs.select(F.col("bcp_47").alias("key"), "speakers")
            .unionByName(pop.select(F.concat_ws("-", "bcp_47", cc).alias("key"),
                                    F.col("population").alias("speakers")))
            .unionByName(langs.where(F.col("family") == "EUROPE")
                         .select(F.lit("no").alias("key"), "speakers"))
            .unionByName(langs.where(F.col("family") == "ASIA")
                         .select(F.lit("nb").alias("key"), "speakers")))
    names = langs.select("bcp_47", "language_name", F.lower("language_name").alias("autonym"))
    variants = pop.select(F.concat_ws("-", "bcp_47", _cap4(F.col("iso2"))).alias("code"),
                          F.concat_ws("_", "bcp_47", _cap4(F.col("iso2"))).alias("flores_path"),
                          "population")
    scripts = pop.select(_cap4(F.col("iso2")).alias("iso15924"),
                         F.initcap(F.lower("iso2")).alias("script_name")).distinct()
    locales = pop.select(F.concat_ws("-", "bcp_47", cc).alias("locale"),
                         (F.col("population") / 100.0).alias("hours"))
    n, r = ctx.t.nation, ctx.t.region
    languoids = (n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
                          F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("family_id"),
                          F.col("n_name").alias("name"), F.col("n_name").alias("iso"))
                 .unionByName(r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"),
                                       F.lit(None).cast("string").alias("family_id"),
                                       F.col("r_name").alias("name"), F.col("r_name").alias("iso"))))
    return keys, names, variants, scripts, locales, languoids


def _fleurs_tags(ctx):
    """Speech tags of the languages of two regions: code, two underscores, country."""
    pop = ctx.view("population").join(ctx.languages.where("family IN ('EUROPE', 'AFRICA')").select("bcp_47"), "bcp_47", "left_semi")
    return pop.select(F.concat("bcp_47", F.lit("__"), F.lower(F.substring("iso2", 1, 2))).alias("fleurs_tag"))


_CTES = [
    ("pk", """SELECT bcp_47 AS key, speakers FROM languages
      UNION ALL SELECT bcp_47 || '-' || upper(substr(iso2, 1, 2)), population FROM population
      UNION ALL SELECT 'no', speakers FROM languages WHERE family = 'EUROPE'
      UNION ALL SELECT 'nb', speakers FROM languages WHERE family = 'ASIA'"""),
    ("lk", "SELECT * FROM pk WHERE NOT regexp_matches(key, '-[A-Z]{2}$')"),
    ("std", """SELECT coalesce(m.t, lk.key) AS bcp_47, speakers FROM lk
      LEFT JOIN (VALUES ('no', 'nb')) m(f, t) ON m.f = lk.key"""),
    ("merged", "SELECT bcp_47, CAST(sum(speakers) AS BIGINT) AS speakers FROM std GROUP BY bcp_47"),
    ("named", """SELECT m.bcp_47, m.speakers, l.language_name,
        upper(substr(lower(l.language_name), 1, 1)) || substr(lower(l.language_name), 2) AS autonym
      FROM merged m LEFT JOIN languages l ON l.bcp_47 = m.bcp_47"""),
    ("var", """SELECT bcp_47 || '-' || upper(substr(iso2, 1, 1)) || lower(substr(iso2, 2, 3)) AS code,
        bcp_47 || '_' || upper(substr(iso2, 1, 1)) || lower(substr(iso2, 2, 3)) AS flores_path, population
      FROM population"""),
    ("fl", """SELECT regexp_replace(code, '-[A-Z][a-z0-9-]+$', '') AS bcp_47,
        arg_min(flores_path, (-population, flores_path)) AS flores_path FROM var GROUP BY 1"""),
    ("scripts", """SELECT DISTINCT upper(substr(iso2, 1, 1)) || lower(substr(iso2, 2, 3)) AS iso15924,
        upper(substr(iso2, 1, 1)) || lower(substr(iso2, 2)) AS script_name FROM population"""),
    ("cv", """SELECT regexp_replace(locale, '-[A-Z]{2}$', '') AS bcp_47, sum(hours) AS commonvoice_hours,
        min(locale) AS commonvoice_locale
      FROM (SELECT bcp_47 || '-' || upper(substr(iso2, 1, 2)) AS locale, population / 100e0 AS hours
            FROM population) GROUP BY 1"""),
    ("fleurs", """SELECT p.bcp_47, min(p.bcp_47 || '__' || lower(substr(p.iso2, 1, 2))) AS fleurs_tag
      FROM population p JOIN languages l ON l.bcp_47 = p.bcp_47 AND l.family IN ('EUROPE', 'AFRICA') GROUP BY p.bcp_47"""),
    ("lg", """SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS id, 'r' || CAST(n_regionkey AS VARCHAR) AS family_id,
        n_name AS name, n_name AS iso FROM nation
      UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), NULL, r_name, r_name FROM region"""),
    ("lf", """SELECT f.bcp_47, p.name AS family FROM (
        SELECT iso AS bcp_47, family_id FROM lg WHERE iso IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY iso ORDER BY id, family_id NULLS FIRST) = 1) f
      LEFT JOIN lg p ON p.id = f.family_id"""),
]
_USES = ["languages", "population"]


@query("language_dimension", _USES, """
SELECT n.bcp_47, n.speakers, n.language_name, n.autonym, lf.family, fl.flores_path, fleurs.fleurs_tag,
  cv.commonvoice_hours, cv.commonvoice_locale, fl.bcp_47 IS NOT NULL AS in_benchmark
FROM named n LEFT JOIN lf ON lf.bcp_47 = n.bcp_47 LEFT JOIN fl ON fl.bcp_47 = n.bcp_47
LEFT JOIN cv ON cv.bcp_47 = n.bcp_47 LEFT JOIN fleurs ON fleurs.bcp_47 = n.bcp_47""", _CTES)
def language_dimension(ctx):
    """Language rows with names, family and coverage."""
    keys, names, variants, _, locales, languoids = _inputs(ctx)
    langs = L.merge_duplicates(L.standardise_codes(L.language_keys(keys))
                               .select("bcp_47", "speakers"))
    langs = L.attach_names(langs, names).join(L.language_family(languoids), "bcp_47", "left")
    out = L.build_languages(langs, L.pick_variant(variants), L.commonvoice_coverage(locales),
                            L.fleurs_coverage(_fleurs_tags(ctx)))
    return out.select("bcp_47", "speakers", "language_name", "autonym", "family", "flores_path", "fleurs_tag",
                      "commonvoice_hours", "commonvoice_locale", "in_benchmark")


@query("language_family", _USES, "SELECT * FROM lf", _CTES)
def language_family(ctx):
    """Family via languoid self-join; NULL for top-level languoids."""
    return L.language_family(_inputs(ctx)[5])


@query("script_lookup", _USES, """
SELECT fl.bcp_47, fl.flores_path, s.script_name FROM fl
LEFT JOIN scripts s ON s.iso15924 = string_split(fl.flores_path, '_')[-1]""", _CTES)
def script_lookup(ctx):
    """Script name of each language's chosen variant."""
    _, _, variants, scripts, _, _ = _inputs(ctx)
    return L.script_names(L.pick_variant(variants), scripts)


@query("variant_pick", _USES, "SELECT * FROM fl", _CTES)
def variant_pick(ctx):
    """Strip script suffix, pick the most-written variant."""
    return L.pick_variant(_inputs(ctx)[2])
