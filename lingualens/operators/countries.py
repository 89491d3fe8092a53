"""Country view of the language table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def _country_rows(language_table: DataFrame, population: DataFrame) -> DataFrame:
    lt = language_table.select("bcp_47", F.col("language_name").alias("name"),
                               F.col("average").alias("score"))
    return population.select("bcp_47", "iso2", "population").join(lt, "bcp_47")


def country_scores(language_table: DataFrame, population: DataFrame,
                   min_population: int = K.COUNTRY_MIN_POPULATION) -> DataFrame:
    """Population-weighted mean of language averages per country.

    A language without a score counts as 0 here (unlike elsewhere); a country
    with fewer than ``min_population`` speakers gets no score.
    """
    rows = _country_rows(language_table, population)
    g = rows.groupBy("iso2").agg(
        F.sum("population").alias("population"),
        F.count(F.lit(1)).alias("n_languages"),
        F.sum(F.coalesce(F.col("score"), F.lit(0.0)) * F.col("population")).alias("_w"))
    score = F.when(F.col("population") < min_population, F.lit(None).cast("double")) \
        .otherwise(F.col("_w") / F.col("population"))
    return g.select("iso2", "population", "n_languages", score.alias("score"))


def country_table(language_table: DataFrame, population: DataFrame,
                  min_population: int = K.COUNTRY_MIN_POPULATION) -> DataFrame:
    """Per country: score plus the nested list of its languages.

    A country's list holds one entry per language spoken there, so its
    length is bounded by the language dimension, not by the log.
    """
    rows = _country_rows(language_table, population)
    nested = rows.groupBy("iso2").agg(F.sort_array(F.collect_list(
        F.struct("name", "bcp_47", "population", "score"))).alias("languages"))
    return country_scores(language_table, population, min_population).join(nested, "iso2")
