"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import constants as K

HELPER_COLUMNS = ("__index_level_0__",)

# Schemas are DDL strings (accepted by readers and createDataFrame), so the
# module imports without a running session.

RESULTS_DETAILED = (
    "model string, bcp_47 string, task string, metric string, score double, origin string, "
    "sentence_nr int, prompt string, response string, status string")
RESULTS = (
    "model string, bcp_47 string, task string, metric string, score double, origin string")
MODEL_HEALTH = (
    "model string, total bigint, failed bigint, score_nonfailed double, failed_pct double")
SCRIPT_CODES = (
    "Code string, `N°` string, `English Name` string, `Nom français` string, Alias string, "
    "Age string, Date string")
LANGUOID = ("id string, family_id string, name string, iso639P3code string")
DATASET_CATALOG = (
    "name string, author string, author_url string, url string, n_languages string, "
    "languages array<string>, tasks array<string>, parallel boolean, translation string, "
    "base string, implemented boolean, `group` string")
SPEECH_TSV = (
    "id string, fname string, raw_transcription string, transcription string, words string, "
    "id2 string, gender string")


CURRENT = "_CURRENT"


def _fs(spark: SparkSession, path: str):
    """Hadoop file system and path object of ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Metadata check through the Hadoop file system of the path."""
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def drop_partition(spark: SparkSession, path: str) -> None:
    """Remove one partition folder of a table."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder that holds the published version of a table, if there is one."""
    fs, p = _fs(spark, f"{path}/{CURRENT}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return f"{path}/{stream.readLine()}"
    finally:
        stream.close()


def _switch(spark: SparkSession, path: str, version: str) -> None:
    """Point the table at ``version``: the pointer is written beside its place
    and renamed over it, so readers see the old version or the new one."""
    jvm = spark.sparkContext._jvm
    fs, tmp = _fs(spark, f"{path}/{CURRENT}.{version}")
    out = fs.create(tmp, True)
    try:
        out.writeBytes(version + "\n")
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(tmp, jvm.org.apache.hadoop.fs.Path(f"{path}/{CURRENT}"), how)


def load(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A stored table, or an empty one of the same schema if absent (A1).  A
    table of a published set (``sources.manifest``) is that of its manifest."""
    from . import manifest
    base, _, name = path.rstrip("/").rpartition("/")
    if manifest.current(spark, base).paths.get(name):
        return manifest.load(spark, base, name, schema)
    version = current_version(spark, path)
    if version or path_exists(spark, path):
        return spark.read.schema(schema).parquet(version or path)
    return spark.createDataFrame([], schema)


def save(df: DataFrame, path: str, json_path: str | None = None,
         partition_by: list[str] | None = None) -> None:
    """Publish a table snapshot: drop helper columns, write parquet, and
    optionally a JSON copy (A2).

    The snapshot goes to a new version folder and the table is switched to
    it when it is complete, so ``df`` may read the table that it replaces,
    and a failed job leaves the published version as it was.
    """
    spark = df.sparkSession
    out = df.drop(*[c for c in HELPER_COLUMNS if c in df.columns])
    version = f"v-{uuid.uuid4().hex}"
    w = out.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{path}/{version}")
    if json_path:
        # From the written files: what was published, and computed once.
        spark.read.schema(out.schema).parquet(f"{path}/{version}").write.mode("overwrite").json(json_path)
    _switch(spark, path, version)


def save_local_only(df: DataFrame, json_path: str) -> None:
    """Snapshot to a second location only, as JSON records (A3)."""
    df.drop(*[c for c in HELPER_COLUMNS if c in df.columns]).write.mode("overwrite").json(json_path)


def publish_target(cohort_models: DataFrame, cohort_languages: DataFrame,
                   min_languages: int = K.PUBLISH_MIN_LANGUAGES,
                   min_models: int = K.PUBLISH_MIN_MODELS) -> DataFrame:
    """One row: the measured cohort scale and whether aggregates may be
    published (A4).  A partial-scale run writes aggregates locally only;
    the log is always published."""
    n_lang = cohort_languages.agg(F.countDistinct("bcp_47")).scalar()
    m = cohort_models.agg(F.countDistinct("model").alias("n_models"))
    return m.select("n_models", n_lang.alias("n_languages"),
                    ((F.col("n_models") >= min_models) & (n_lang >= min_languages))
                    .alias("publish_aggregates"))


def guarded_publish(spark: SparkSession, log: DataFrame, aggregate: DataFrame, models: DataFrame, languages: DataFrame,
                    cohort_models: DataFrame, cohort_languages: DataFrame,
                    published_dir: str, local_dir: str) -> bool:
    """Publish the log always, and the aggregate, models and languages only at
    full scale, else write them to the local location (A4).  Returns whether
    they were published.  The decision reads one aggregated row.

    What is published becomes visible at once, by one manifest
    (``sources.manifest``; read it with ``manifest.load``): a failure between
    two tables leaves the set as it was.
    """
    from . import manifest
    decision = publish_target(cohort_models, cohort_languages).first()
    tables = {"results": aggregate, "models": models, "languages": languages}
    full = bool(decision and decision["publish_aggregates"])
    if not full:
        for name, df in tables.items():
            save_local_only(df, f"{local_dir}/{name}")
    manifest.updated(spark, published_dir, lambda held: {"results-detailed": log, **(tables if full else {})})
    return full


def merge_and_publish(spark: SparkSession, new_rows: DataFrame, path: str) -> DataFrame:
    """Load the published log, merge new rows with keep-last and publish the
    result on the same path; returns the published log."""
    from ..operators.log import keep_last
    schema = new_rows.schema
    merged = keep_last(load(spark, path, schema).unionByName(new_rows))
    save(merged.select(schema.names), path)
    return load(spark, path, schema)


def read_csv_na_empty_only(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with header where only the empty string is missing (A5): text such
    as 'NA' or 'Nan' stays a value."""
    return (spark.read.schema(schema).option("header", True).option("nullValue", "")
            .option("nanValue", "\u0000nan-disabled").csv(path))


def read_json_array(spark: SparkSession, path: str, schema: StructType | str = DATASET_CATALOG) -> DataFrame:
    """A JSON array file whose ``n_languages`` mixes numbers, digit strings
    and null (A6): read as text, typed with ``try_cast``."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.withColumn("n_languages", F.col("n_languages").try_cast("int"))


def read_tsv(spark: SparkSession, path: str, schema: StructType | str = SPEECH_TSV) -> DataFrame:
    """Tab-separated file without header, named columns."""
    return spark.read.schema(schema).option("sep", "\t").option("header", False).csv(path)


def write_health_snapshot(health: DataFrame, path: str) -> None:
    """Health records as JSON, worst failure rate first (A9).  The sort is
    a range-partitioned ``orderBy``: part files are written in order."""
    health.orderBy(F.col("failed_pct").desc(), F.col("model")).write.mode("overwrite").json(path)
