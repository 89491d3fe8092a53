"""The dashboard payload as a report job (A10).

The reference answers one HTTP request with seven collections; here the same
collections are DataFrames built from the tables, written as JSON by
``write_dashboard``.  Nothing is collected: NULL stays NULL in JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from ..operators import bootstrap as bs
from ..operators import countries
from ..operators import history as hist
from ..operators import leaderboard as lb

COLLECTIONS = ["model_table", "language_table", "dataset_table", "countries",
               "machine_translated_metrics", "language_tier_history", "license_history"]


def build_dashboard(cells: DataFrame, cube: DataFrame, models: DataFrame,
                    languages: DataFrame, population: DataFrame, dataset_catalog: DataFrame,
                    selected: DataFrame | None = None) -> dict[str, DataFrame]:
    """Seven collections for a language selection (A10); no selection = all.

    ``cells`` are the guarded cells and ``cube`` the cube of the merged log
    (``operators.log``), both made once: every collection is a roll-up of
    them, and the log isn't read again.  The selection narrows the model table
    and the countries only; the language table, tier and license histories
    always use everything.
    """
    results = cells.where("published")
    sel_cells = lb.select_languages(cells, selected)

    model_table = lb.full_model_table(sel_cells.where("published"), lb.select_languages(cube, selected), models)

    lang = lb.language_board(cells, languages)
    l_ci = bs.wide_intervals(bs.metric_intervals(cube, "bcp_47"), "bcp_47")
    language_table = lang.join(l_ci, "bcp_47", "left")

    country = countries.country_table(lb.language_board(sel_cells, languages), population)

    return {
        "model_table": model_table,
        "language_table": language_table,
        "dataset_table": dataset_catalog,
        "countries": country,
        "machine_translated_metrics": lb.machine_metrics(results),
        "language_tier_history": hist.tier_scores(results, languages, models),
        "license_history": hist.license_history(results, models),
    }


def write_dashboard(payload: dict[str, DataFrame], path: str) -> None:
    """Each collection as JSON records under ``path/<name>``."""
    for name, df in payload.items():
        df.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


#: What tells the rows of a collection apart.
KEYS = {"model_table": ["model"], "language_table": ["bcp_47"], "dataset_table": ["name"], "countries": ["iso2", "bcp_47"],
        "machine_translated_metrics": ["task_metric"], "language_tier_history": ["tier", "model"], "license_history": ["model"]}


def payload_values(spark: SparkSession, payload: dict[str, DataFrame], path: str) -> DataFrame:
    """(collection, key, field, number, text): every value of a written
    payload, read from its files; a country's languages are rows of their own.
    NULLs have no row, as in the JSON."""
    out = None
    for name, df in payload.items():
        t = spark.read.schema(df.schema).json(f"{path.rstrip('/')}/{name}")
        if name == "countries":
            t = t.withColumn("_l", F.explode("languages")).select(
                "iso2", "population", "n_languages", "score", F.col("_l.name").alias("language_name"), F.col("_l.bcp_47").alias("bcp_47"),
                F.col("_l.population").alias("language_population"), F.col("_l.score").alias("language_score"))
        values = []
        for f in t.schema.fields:
            if f.name in KEYS[name]:
                continue
            c = F.array_join(f.name, ",") if isinstance(f.dataType, ArrayType) else F.col(f.name)
            numeric = isinstance(f.dataType, NumericType)
            values.append(F.struct(F.lit(f.name).alias("field"), (c if numeric else F.lit(None)).cast("double").alias("number"),
                                   (F.lit(None) if numeric else c).cast("string").alias("text")))
        values.append(F.struct(F.lit("").alias("field"), F.lit(1.0).alias("number"), F.lit(None).cast("string").alias("text")))
        t = (t.select(F.lit(name).alias("collection"), F.concat_ws("/", *KEYS[name]).alias("key"), F.inline(F.array(*values)))
             .where("number IS NOT NULL OR text IS NOT NULL"))
        out = t if out is None else out.unionByName(t)
    return out
