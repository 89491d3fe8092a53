"""A training corpus from raw documents, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of ``docs``.

* ``language_id`` drops texts that no learned language explains better than
  plain bytes, and texts without a letter; without any labelled row only the
  latter.
* ``near_duplicates`` keeps the document of smallest id of each group of
  documents linked by 3-word shingles (Jaccard 0.9 or more).
* ``decontaminate`` drops documents of whose words a twentieth or more lie in
  13-word windows of benchmark items.
* ``secrets`` masks secret values and keeps every document.
* ``packing`` cuts the documents into pieces and packs them in sequences of
  2048 tokens; one row a piece.

Null texts are empty: the first stage drops them.  Repeated rows are one group
of the second stage.  Extra columns are carried along.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingualens.llm import decontam, langid, ngram_join, packing, secrets
from lingualens.llm.workspace import ship, stored
from lingualens.sources.tables import Tables

_RESULT = "__llm_result"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = langid.learn(docs)
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = langid.predict(docs, model, name=_RESULT)
    return found.where(langid.accepted(_RESULT)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contamination(docs, Tables(spark, sf_dir).benchmark, name=_RESULT)
    r = F.col(_RESULT)
    return found.where(~decontam.is_contaminated(r["n_hit"], r["n_words"])).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("secrets", secret_scan), ("packing", pack)]

#: SQL can't express the first stage's model, nor packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ship(spark)
    docs = Tables(spark, sf_dir).documents
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
