"""The registered queries of this subpackage and their DuckDB SQL.

Each query applies its operator, with production parameters, to its whole
table.  ``ORACLE_SQL`` has an entry where SQL can say the same.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables
from . import (align, chat, decontam, langid, merkle, mtree, ngram_join, packing, pii, secrets, spelling,
               suffix_dedup, url_filter)
from .workspace import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 2048 tokens as possible."""
    return packing.packed(Tables(spark, sf_dir).documents)


@query
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that aren't held out."""
    return langid.digest(Tables(spark, sf_dir).documents)


@query
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered turns of the conversations that prefix no longer one."""
    return chat.rendered(Tables(spark, sf_dir).conversations)


@query
def op4_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every 50th vector against all."""
    return mtree.digest(Tables(spark, sf_dir).embeddings, longest=None)


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    t = Tables(spark, sf_dir)
    return decontam.digest(t.documents, t.benchmark)


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.digest(Tables(spark, sf_dir).documents)


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 200 bytes that repeat."""
    return suffix_dedup.digest(Tables(spark, sf_dir).documents)


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digest(Tables(spark, sf_dir).documents)


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list entries active when it was fetched."""
    pages = Tables(spark, sf_dir).pages
    return url_filter.judged(url_filter.fetched(pages), url_filter.list_log(pages))


@query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with 3-word shingle Jaccard of 0.9 or more."""
    return ngram_join.joined(Tables(spark, sf_dir).documents)


@query
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprint of every document and of an edited form of it."""
    return merkle.digest(Tables(spark, sf_dir).documents)


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers' tokens of every document."""
    return align.digest(Tables(spark, sf_dir).documents)


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words and the form they vary."""
    return spelling.digest(Tables(spark, sf_dir).documents)


ORACLE_SQL["op3_chat"] = chat.SQL
ORACLE_SQL["op4_mtree"] = mtree.SQL
ORACLE_SQL["op9_url_filter"] = url_filter.SQL
ORACLE_SQL["op11_fingerprints"] = merkle.SQL
