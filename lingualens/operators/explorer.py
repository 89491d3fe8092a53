"""Explorer queries behind the dashboard tables and charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.ordered import Key, desc, global_rank, running

# --- fixed values -----------------------------------------------------------
# Languages listed first, in this order, when the search box is empty.
PINNED_CODES = [
    "en", "zh", "hi", "es", "ar", "bn", "pt", "ru", "ja", "pa",
    "de", "jv", "ko", "fr", "te", "mr", "tr", "ta", "vi", "ur",
]
# Metrics that count a language as evaluated (includes truthfulqa).
EVALUATED_METRICS = [
    "translation_from_bleu", "translation_to_bleu", "classification_accuracy",
    "mmlu_accuracy", "arc_accuracy", "truthfulqa_accuracy", "mgsm_accuracy",
]
# ---------------------------------------------------------------------------


def speaker_cumulative(language_table: DataFrame, top: int = 100) -> DataFrame:
    """Cumulative speakers and share of all speakers, largest first.

    The total is a scalar subquery (computed once); the running sum is the
    distributed scan, and ``top`` is the chart's fixed length.
    """
    lt = language_table.select("bcp_47", "language_name", "speakers")
    total = lt.agg(F.sum("speakers")).scalar()
    order = [desc("speakers"), "bcp_47"]
    ranked = global_rank(lt, order, out="rank")
    cum = running(ranked.where(F.col("rank") <= top), ["rank"], F.col("speakers"), "sum",
                  "cum_speakers")
    return cum.withColumn("cum_share", F.col("cum_speakers") / total)


def positive_languages(language_table: DataFrame, label_above: int = 100_000_000) -> DataFrame:
    """Languages with a positive average; label the large ones."""
    return (language_table.where(F.col("average") > 0)
            .select("bcp_47", "language_name", "speakers", "average",
                    (F.col("speakers") > label_above).alias("show_label")))


def country_top_languages(country_rows: DataFrame, top: int = 10) -> DataFrame:
    """Per country: its ``top`` languages by population and their share.

    Windows are per country; a country's rows are its languages, bounded by
    the language dimension.
    """
    from pyspark.sql import Window
    by_country = Window.partitionBy("iso2")
    ordered = by_country.orderBy(F.col("population").desc(), F.col("bcp_47"))
    return (country_rows
            .withColumn("share", F.col("population") / F.sum("population").over(by_country))
            .withColumn("pos", F.row_number().over(ordered))
            .where(F.col("pos") <= top))


def evaluated_language_count(language_table: DataFrame,
                             metrics: Sequence[str] = EVALUATED_METRICS) -> DataFrame:
    """Number of languages with at least one metric value (I13).  The table
    has a column for each of ``metrics`` (``language_board(shown=...)``)."""
    return language_table.agg(
        F.count_if(F.coalesce(*metrics).isNotNull()).alias("evaluated_languages"),
        F.count(F.lit(1)).alias("all_languages"))


def _between(c: Column, rng):
    if rng is None:
        return F.lit(True)
    lo, hi = rng
    return c.between(lo, hi)


def _isin(c: Column, values):
    return F.lit(True) if values is None else c.isin(list(values))


def _contains(c: Column, text):
    return F.lit(True) if text is None else F.lower(c).contains(text.lower())


def model_filter(board: DataFrame, providers=None, name=None, types=None,
                 size=None, cost=None) -> DataFrame:
    """Model table filters; ``None`` (full range) means no filter."""
    cond = (_isin(F.col("provider_name"), providers) & _contains(F.col("name"), name)
            & _isin(F.col("type"), types) & _between(F.col("cost"), cost))
    if "size" in board.columns:
        cond = cond & _between(F.col("size"), size)
    return board.where(cond)


def language_filter(language_table: DataFrame, name=None, families=None, speakers=None,
                    selected: DataFrame | None = None) -> DataFrame:
    """Language table filters; selected languages are listed elsewhere."""
    t = language_table.where(_contains(F.col("language_name"), name)
                             & _isin(F.col("family"), families)
                             & _between(F.col("speakers"), speakers))
    if selected is not None:
        t = t.join(selected.select("bcp_47"), "bcp_47", "left_anti")
    return t


def filter_values(board: DataFrame, language_table: DataFrame, n_families: int = 10) -> DataFrame:
    """Filter choices: sorted distinct providers; the first ``n_families``
    families in table order (speakers, largest first) plus 'Other' (I16)."""
    providers = (board.where(F.col("provider_name").isNotNull())
                 .select(F.lit("provider").alias("kind"), F.col("provider_name").alias("value"))
                 .distinct())
    first_seen = (language_table
                  .groupBy("family")
                  .agg(F.min(F.struct(F.col("speakers") * -1, F.col("bcp_47"))).alias("_first")))
    fam = (first_seen.orderBy("_first").limit(n_families)
           .select(F.lit("family").alias("kind"), F.col("family").alias("value")))
    other = language_table.sparkSession.createDataFrame([("family", "Other")], "kind string, value string")
    return providers.unionByName(fam).unionByName(other)


def language_search(language_table: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """Case-insensitive search over name, autonym and code; first ``limit``
    in table order (I17)."""
    q = term.lower()
    cols = [c for c in ("language_name", "autonym", "bcp_47") if c in language_table.columns]
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.lower(F.col(c)).contains(q)
    return (language_table.where(cond)
            .orderBy(F.col("speakers").desc_nulls_last(), F.col("bcp_47"))
            .limit(limit))


def pinned_order(language_table: DataFrame, pinned: Sequence[str] = PINNED_CODES) -> DataFrame:
    """Default list order: pinned codes first in list order, then by name."""
    pos = F.array_position(F.array(*[F.lit(c) for c in pinned]), F.col("bcp_47"))
    key = F.when(pos > 0, pos)
    return global_rank(language_table.select("bcp_47", "language_name"),
                       [Key(key, nulls_last=True), "language_name", "bcp_47"],
                       out="position")


def catalog_filter(catalog: DataFrame, tasks=None, translation=None, n_languages=None) -> DataFrame:
    """Dataset catalog filters: any task in ``tasks``, translation kind in
    ``translation``, language count in range (I19)."""
    n = F.col("n_languages").try_cast("int")
    cond = _isin(F.col("translation"), translation) & _between(n, n_languages)
    if tasks is not None:
        cond = cond & F.arrays_overlap(F.col("tasks"), F.array(*[F.lit(t) for t in tasks]))
    return catalog.where(cond).select("name", "catalog_group", n.alias("n_languages"),
                                      "translation", "tasks", "implemented")


def catalog_groups(catalog: DataFrame) -> DataFrame:
    """Catalog rows grouped for display: each row's place in its group (most
    languages first, then by name) and the group's size (I19).  A group holds
    the datasets of one collection, so its window is small."""
    from pyspark.sql import Window
    group = Window.partitionBy("catalog_group")
    n = F.col("n_languages").try_cast("double")
    return catalog.select("catalog_group", "name", n.alias("n_languages")).select(
        "*", F.count(F.lit(1)).over(group).alias("group_size"),
        F.row_number().over(group.orderBy(F.col("n_languages").desc_nulls_last(), "name")).alias("pos"))


def catalog_tasks(catalog: DataFrame) -> DataFrame:
    """Distinct tasks of the catalog."""
    return catalog.select(F.explode("tasks").alias("task")).distinct()


def sorted_table(df: DataFrame, field: str, descending: bool = True) -> DataFrame:
    """Sort by one column, NULLs last."""
    c = F.col(field)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())
