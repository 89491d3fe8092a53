"""Evaluation-shaped tables derived from the driver's parquet tables.

Each function maps the TPC-H-ish input onto one table of the evaluation data
model (per-sample result log, model and language dimensions, ...).  The
mapping is fixed in FIXTURES.md §3; ``lingualens.plans.oracle`` holds the same
mapping as SQL for DuckDB.  Joins are ordered so that the largest input
(``lineitem``) is shuffled as few times as possible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import FIXED_ROWS, bounded
from .tables import Tables

SENTENCES_PER_URL = 25


def _nation(t: Tables) -> DataFrame:
    return bounded(t.nation.select("n_nationkey", "n_name", "n_regionkey"), FIXED_ROWS["nation"])


def _region(t: Tables) -> DataFrame:
    return bounded(t.region.select("r_regionkey", "r_name"), FIXED_ROWS["region"])


def _num_suffix(c: str, start: int) -> Column:
    """``CAST(substr(c, start) AS int)``."""
    return F.expr(f"substr({c}, {start})").cast("int")


def task_of_type(p_type: Column) -> Column:
    return (F.when(p_type == "ECONOMY", "translation_from")
            .when(p_type == "LARGE", "translation_to")
            .when(p_type == "MEDIUM", "classification")
            .when(p_type == "PROMO", "mmlu")
            .when(p_type == "SMALL", "arc")
            .otherwise("mgsm"))


def result_log(t: Tables) -> DataFrame:
    """Per-sample log: one row per attempt, with duplicates on the 5-key."""
    n = _nation(t)
    # orders -> customer -> nation first (orders-sized), so lineitem is
    # shuffled once on orderkey and once on partkey.
    order_lang = (t.orders.select("o_orderkey", "o_custkey")
                  .join(t.customer.select("c_custkey", "c_nationkey"),
                        F.col("o_custkey") == F.col("c_custkey"))
                  .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
                  .select("o_orderkey", "n_name"))
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                           "l_quantity", "l_discount", "l_returnflag", "l_shipdate",
                           "l_extendedprice")
    part = t.part.select("p_partkey", "p_type")
    j = (li.join(order_lang, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(part, F.col("l_partkey") == F.col("p_partkey")))
    is_translation = F.col("p_type").isin("ECONOMY", "LARGE")
    q = F.col("l_quantity")
    return j.select(
        F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("model"),
        F.col("n_name").alias("bcp_47"),
        task_of_type(F.col("p_type")).alias("task"),
        F.when(is_translation, "bleu").otherwise("accuracy").alias("metric"),
        F.col("l_linenumber").alias("sentence_nr"),
        F.when(q <= 5, F.lit(0.0))
         .when(is_translation, F.col("l_discount") * 10)
         .when(F.col("l_discount") >= 0.05, F.lit(1.0))
         .otherwise(F.lit(0.0)).alias("score"),
        F.when(F.col("l_returnflag") == "A", "machine").otherwise("human").alias("origin"),
        F.when(q <= 5, "error").when(q <= 10, F.lit(None).cast("string"))
         .otherwise("ok").alias("status"),
        F.col("l_shipdate").alias("logged_at"),
        F.col("l_orderkey").alias("tie1"),
        F.col("l_partkey").alias("tie2"),
        F.col("l_extendedprice").alias("tie3"),
    )


def models(t: Tables) -> DataFrame:
    """Model dimension: one row per supplier."""
    # Partial aggregation of lineitem by supplier before the join.
    first_seen = (t.lineitem.groupBy("l_suppkey")
                  .agg(F.min(F.col("l_shipdate").cast("date")).alias("creation_date")))
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return (s.join(_nation(t), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(first_seen, F.col("s_suppkey") == F.col("l_suppkey"), "left")
            .select(
                F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("id"),
                F.col("s_name").alias("name"),
                F.col("n_name").alias("provider_name"),
                (F.col("s_acctbal") / 250).alias("cost"),
                F.when(F.col("s_suppkey") % 3 == 0, "open-source")
                 .otherwise("closed-source").alias("type"),
                "creation_date",
                # Only open models have weights: a hub id, a size and a license.
                F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lower("n_name"), F.lit("/model-"), F.col("s_suppkey").cast("string"))).alias("hf_id"),
                F.when(F.col("s_suppkey") % 3 == 0, (F.col("s_suppkey") % 70 + 1) * 1e9).alias("size"),
                F.when(F.col("s_suppkey") % 3 == 0, F.when(F.col("s_suppkey") % 2 == 0, "Apache 2.0").otherwise("Mit")).alias("license")))


TRANSLATION_TASKS = ["translation_from", "translation_to"]
LOGGED_TASKS = [*TRANSLATION_TASKS, "classification", "mmlu", "arc", "mgsm"]

#: Sub-dataset, task, and the languages it has: those whose nation number
#: leaves ``rest`` when divided by ``every``.
TASK_SOURCES = [
    ("parallel", "translation_from", 7, 0), ("parallel", "translation_to", 7, 0), ("parallel", "classification", 7, 0),
    ("choices_a", "mmlu", 12, 0), ("choices_b", "mmlu", 11, 5), ("choices_machine", "mmlu", 13, 9),
    ("science", "arc", 9, 1), ("science_machine", "arc", 25, 4),
    ("sums_a", "mgsm", 12, 3), ("sums_b", "mgsm", 10, 8), ("sums_machine", "mgsm", 25, 20),
]


def task_sources(t: Tables) -> DataFrame:
    """(source, task, bcp_47): the languages of each sub-dataset of a task."""
    rules = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(k).alias("task"), F.lit(e).alias("every"), F.lit(r).alias("rest"))
                      for s, k, e, r in TASK_SOURCES])
    n = t.nation.select("n_nationkey", F.col("n_name").alias("bcp_47")).withColumn("r", F.explode(rules))
    return n.where(F.col("n_nationkey") % F.col("r.every") == F.col("r.rest")).select("r.source", "r.task", "bcp_47")


def model_tasks(t: Tables) -> DataFrame:
    """(model, tasks): every third model only translates."""
    tasks = F.when(F.col("s_suppkey") % 3 == 0, F.array(*map(F.lit, TRANSLATION_TASKS))).otherwise(F.array(*map(F.lit, LOGGED_TASKS)))
    return t.supplier.select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("model"), tasks.alias("tasks"))


def languages(t: Tables) -> DataFrame:
    """Language dimension: one row per nation."""
    speakers = (t.customer.groupBy("c_nationkey")
                .agg(F.count("c_custkey").alias("n_cust")))
    return (_nation(t).join(_region(t), F.col("n_regionkey") == F.col("r_regionkey"))
            .join(speakers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
            .select(
                F.col("n_name").alias("bcp_47"),
                F.col("n_name").alias("language_name"),
                F.concat(F.lit("Lingua "), F.col("n_nationkey").cast("string")).alias("autonym"),
                F.col("r_name").alias("family"),
                (F.coalesce(F.col("n_cust"), F.lit(0)) * 1000).alias("speakers"),
                (F.col("n_nationkey") < 20).alias("in_benchmark")))


def population(t: Tables) -> DataFrame:
    """Speakers of a language per country code."""
    per = (t.customer.groupBy("c_nationkey", "c_mktsegment")
           .agg(F.count(F.lit(1)).alias("n")))
    return (per.join(_nation(t), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("n_name").alias("bcp_47"),
                    F.col("c_mktsegment").alias("iso2"),
                    (F.col("n") * 50).alias("population")))


def items(t: Tables) -> DataFrame:
    """Dataset items with a source priority rank.  German has no set of rank
    0, Spanish none of rank 0 or 1 (machine translations only)."""
    least = F.when(F.col("lang") == "de", 1).when(F.col("lang") == "es", 2).otherwise(0)
    return t.documents.select(
        "doc_id",
        F.greatest(_num_suffix("source", 4) % 4, least).alias("source_rank"),
        F.col("lang").alias("bcp_47"),
        F.concat(F.lit("subj"), (F.col("doc_id") % 5).cast("string")).alias("subject"),
        (F.col("doc_id") % 200).alias("item_id"))


def paragraphs(t: Tables) -> DataFrame:
    """Sentences with url, position and (nullable) topic.  A page holds
    ``SENTENCES_PER_URL`` consecutive sentences however many there are."""
    d = t.documents.select("doc_id", "lang", "text")
    lab = t.labels.select(F.col("doc_id").alias("l_doc_id"), "quality")
    return (d.join(lab, F.col("doc_id") == F.col("l_doc_id"), "left")
            .withColumn("_url", F.expr(f"doc_id div {SENTENCES_PER_URL}"))
            .select(F.col("_url").alias("url"),
                    F.col("doc_id").alias("pos"),
                    F.col("lang").alias("bcp_47"),
                    F.when(F.col("quality").isNull(), F.lit(None).cast("string"))
                     .otherwise(F.concat(F.lit("Topic"),
                                         (F.col("_url") % 7).cast("string")))
                     .alias("topic"),
                    "text"))


def responses(t: Tables) -> DataFrame:
    """Raw model responses with the expected answer letter: the assistant's
    text as the reasoning, followed by a tagged answer."""
    c = t.conversations.select("conv_id", "turn", "role", "text").where(F.col("role") == "assistant")
    k = (F.col("conv_id") + F.col("turn")) % 6
    letter_conv = F.expr("substr('ABCD', CAST(conv_id % 4 AS int) + 1, 1)")
    letter_sum = F.expr("substr('ABCD', CAST((conv_id + turn) % 4 AS int) + 1, 1)")
    return c.select(
        "conv_id", "turn",
        F.when(k == 0, F.lit(None).cast("string"))
         .when(k == 1, F.concat(F.lit("<think>"), F.col("text"),
                                F.lit("</think><final_answer>\u3000"), letter_conv,
                                F.lit("\u00a0</final_answer>")))
         .when(k == 2, F.col("text"))
         .otherwise(F.concat(F.lit("<reasoning>"), F.col("text"),
                             F.lit("</reasoning><final_answer>"), letter_sum,
                             F.lit("</final_answer>"))).alias("response"),
        letter_conv.alias("answer"))


def run_health(t: Tables) -> DataFrame:
    """Per (model, run) attempt and failure counts."""
    e = t.events.select("event_id", "user_id", "event_type")
    failed = (F.when(F.col("event_type").isin("error", "view")
                     & (((F.col("user_id") + F.col("event_id") % 10) % 3) != 0), 1)
              .when(((F.col("user_id") % 30 + F.col("event_id") % 10) % 4) == 0, 1)
              .otherwise(0))
    return (e.groupBy((F.col("user_id") % 30).alias("u"), (F.col("event_id") % 10).alias("r"))
            .agg(F.count(F.lit(1)).alias("total"), F.sum(failed).alias("failed"))
            .select(F.concat(F.lit("u"), F.col("u").cast("string")).alias("model"),
                    F.floor(F.col("r")).cast("int").alias("run_nr"), "total", "failed"))


def timings(t: Tables) -> DataFrame:
    """Seconds spent per attempted sample."""
    return t.events.select(
        F.concat(F.lit("u"), (F.col("user_id") % 30).cast("string")).alias("model"),
        (F.col("value") * (F.col("user_id") % 30) / 2500).alias("seconds"))


def catalog(t: Tables) -> DataFrame:
    """Raw model catalog (flattened form of the nested JSON catalog)."""
    p = t.part.select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    suffix = (F.when(F.col("p_type") == "ECONOMY", "-mini")
              .when(F.col("p_type") == "LARGE", "-pro")
              .when(F.col("p_type") == "MEDIUM", "-70b")
              .when(F.col("p_type") == "PROMO", "-preview")
              .when(F.col("p_type") == "SMALL", "-flash")
              .otherwise(""))
    return p.select(
        F.concat(F.lit("vendor"), (k % 25).cast("string"), F.lit("/"),
                 F.regexp_replace("p_name", " ", "-"), F.lit("-"),
                 F.col("p_size").cast("string"), F.lit("."), (k % 3).cast("string"),
                 suffix).alias("slug"),
        F.concat(F.lit("Vendor "), (k % 25).cast("string"), F.lit(": "), F.col("p_name"),
                 F.when(k % 5 == 0, " (free)").otherwise("")).alias("name"),
        F.when(k % 5 == 0, "0").when(k % 11 == 0, "n/a")
         .otherwise(((F.col("p_retailprice") - 890) / 3000000).cast("string"))
         .alias("price_text"),
        F.when(k % 13 == 0, F.lit(None).cast("date"))
         .otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (k % 700).cast("int")))
         .alias("created"),
        F.when(k % 4 == 1, F.date_add(F.lit("2023-06-01").cast("date"), (k % 900).cast("int"))).alias("repository_created"),
        (k % 17 == 0).alias("trains_on_prompts"))


def dataset_catalog(t: Tables) -> DataFrame:
    """Dataset catalog: one row per source, mixed-type ``n_languages`` as text."""
    d = t.documents.select("source", "lang")
    sid = _num_suffix("source", 4)
    g = d.groupBy("source").agg(F.countDistinct("lang").alias("n_lang"))
    return g.select(
        F.col("source").alias("name"),
        F.concat(F.lit("group"), (sid % 5).cast("string")).alias("catalog_group"),
        F.when(sid % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("n_lang").cast("string")).alias("n_languages"),
        F.when(sid % 4 == 0, "human").when(sid % 4 == 1, "machine")
         .when(sid % 4 == 2, "mixed").alias("translation"),
        F.split(F.when(sid % 3 == 0, "translation,classification")
                .when(sid % 3 == 1, "mmlu").otherwise("mgsm,arc,translation"), ",")
         .alias("tasks"),
        (sid % 2 == 0).alias("implemented"))


VIEWS = {
    "result_log": result_log,
    "models": models,
    "languages": languages,
    "population": population,
    "items": items,
    "paragraphs": paragraphs,
    "responses": responses,
    "run_health": run_health,
    "timings": timings,
    "catalog": catalog,
    "dataset_catalog": dataset_catalog,
    "task_sources": task_sources,
    "model_tasks": model_tasks,
}
