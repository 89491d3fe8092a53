"""Language dimension build."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.joins import lookup

COUNTRY_SUFFIX = r"-[A-Z]{2}$"
SCRIPT_SUFFIX = r"-[A-Z][a-z0-9-]+$"


def language_keys(population_keys: DataFrame) -> DataFrame:
    """Keep language-only keys, drop ``lang-CC`` country keys (B1)."""
    return population_keys.where(~F.col("key").rlike(COUNTRY_SUFFIX))


def standardise_codes(keys: DataFrame, code_col: str = "key",
                      mapping: dict[str, str] = K.MACROLANGUAGE_MAPPING) -> DataFrame:
    """Map macro-language codes to their preferred member (B2).

    The mapping is a fixed lookup table, broadcast in a left join.
    """
    m = lookup(keys.sparkSession, list(mapping.items()) or [("", "")], "_from string, _to string")
    return (keys.join(m, F.col(code_col) == F.col("_from"), "left")
            .withColumn("bcp_47", F.coalesce(F.col("_to"), F.col(code_col)))
            .drop("_from", "_to"))


def merge_duplicates(langs: DataFrame) -> DataFrame:
    """One row per code, speakers summed."""
    return langs.groupBy("bcp_47").agg(F.sum("speakers").alias("speakers"))


def attach_names(langs: DataFrame, names: DataFrame) -> DataFrame:
    """Display name and title-cased autonym from a names table."""
    n = names.select("bcp_47", "language_name",
                     F.initcap(F.col("autonym")).alias("autonym"))
    return langs.join(n, "bcp_47", "left")


def language_family(languoids: DataFrame) -> DataFrame:
    """Family name per code: first languoid with that code, then its family
    languoid's name; NULL for top-level languoids (B5).

    A self-join of the languoid table on ``family_id = id``.
    """
    first = (languoids.where(F.col("iso").isNotNull())
             .groupBy(F.col("iso").alias("bcp_47"))
             .agg(F.min(F.struct("id", "family_id")).alias("_f"))
             .select("bcp_47", F.col("_f.family_id").alias("family_id")))
    fam = languoids.select(F.col("id").alias("family_id"), F.col("name").alias("family"))
    return first.join(fam, "family_id", "left").select("bcp_47", "family")


def strip_script(code):
    """``xx-Latn`` -> ``xx``."""
    return F.regexp_replace(code, SCRIPT_SUFFIX, "")


def pick_variant(variants: DataFrame) -> DataFrame:
    """One script variant per language: largest writing population, first
    path on ties (B7, B8).  An aggregate, so it combines map-side."""
    v = variants.withColumn("bcp_47", strip_script(F.col("code")))
    return v.groupBy("bcp_47").agg(
        F.min_by("flores_path", F.struct(-F.col("population"), F.col("flores_path")))
        .alias("flores_path"))


def script_names(flores: DataFrame, scripts: DataFrame) -> DataFrame:
    """Script name of each variant path ``lang_Script``."""
    code = F.element_at(F.split(F.col("flores_path"), "_"), -1)
    return (flores.withColumn("iso15924", code)
            .join(scripts.select("iso15924", "script_name"), "iso15924", "left")
            .select("bcp_47", "flores_path", "script_name"))


def commonvoice_coverage(locales: DataFrame) -> DataFrame:
    """Strip the country suffix, sum hours, keep the first locale."""
    return (locales.withColumn("bcp_47", F.regexp_replace("locale", COUNTRY_SUFFIX, ""))
            .groupBy("bcp_47")
            .agg(F.sum("hours").alias("commonvoice_hours"),
                 F.min("locale").alias("commonvoice_locale")))


def fleurs_coverage(tags: DataFrame) -> DataFrame:
    """Speech tag per language: the country suffix is dropped for the key and
    the first tag kept (B10)."""
    return (tags.withColumn("bcp_47", F.regexp_replace(F.replace("fleurs_tag", F.lit("__"), F.lit("-")), "-[a-z]{2}$", ""))
            .groupBy("bcp_47").agg(F.min("fleurs_tag").alias("fleurs_tag")))


def build_languages(langs: DataFrame, flores: DataFrame, commonvoice: DataFrame,
                    fleurs: DataFrame | None = None) -> DataFrame:
    """Left-merge coverage tables and flag benchmark membership."""
    if fleurs is not None:
        langs = langs.join(fleurs, "bcp_47", "left")
    fl = flores.select("bcp_47", "flores_path")
    in_bench = fl.select("bcp_47").distinct().withColumn("in_benchmark", F.lit(True))
    return (langs.join(fl, "bcp_47", "left").join(commonvoice, "bcp_47", "left")
            .join(in_bench, "bcp_47", "left")
            .withColumn("in_benchmark", F.coalesce(F.col("in_benchmark"), F.lit(False))))
