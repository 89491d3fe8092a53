"""Micro-batch maintenance of the result log (K1-K3).

Result files arrive in a folder; a Structured Streaming query merges every
micro-batch into the log with keep-last semantics (K1) and refreshes the
published aggregate for the models that the batch touched (K2); a second,
stateful query keeps a running per-model error rate (K3).

Log, cube (counts per cell and score), published aggregate and, if asked for,
bootstrap intervals are kept in buckets that split as they grow (extendible
hashing): a bucket is the rows whose hash ends in certain bits, and one of more
than ``max_rows`` rows becomes two, four, ... the next time that it is written.
Log and cube are hashed by cell (model, language, task, metric), so a model of
any size lies in many buckets, and a bucket of the cube counts the bucket of
the log with the same hashes: both are made where its rows are merged.  The
others are hashed by model, because the publish guard and the intervals look at
whole models, which have a row for each of their languages, metrics and
different scores at most.

Intervals (H14, H15) are redone from the cube for the models that a batch
touches, never from the log; the others' stay.

A micro-batch writes the buckets that it touches to new folders and then
publishes one manifest that names every bucket of all tables.  Readers
take their buckets from a manifest, so they see the log and the aggregate of
the same batch and never a half-written bucket.  The manifest also holds the
last batch's number: a replayed batch is skipped, and one that failed before
its commit left nothing that anyone reads.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.health import not_ok
from ..operators.bootstrap import metric_intervals
from ..operators.log import CELL, cells_of, guarded_cells, keep_last, log_and_cube, score_cube
from ..sources import manifest as mf

MAX_ROWS = 5_000_000
#: Bits of a hash that tell buckets apart.
MAX_DEPTH = 24
TABLES = {"log": CELL, "cube": CELL, "results": ["model"], "intervals": ["model"]}
#: How rows are dealt to buckets; a set that was dealt otherwise is dealt anew.
LAYOUT = "murmur3"
#: Rows that a task merges, at most twice as many as it has on average.
TASK_ROWS = 250_000
#: So many models are looked for in the cube's files instead of joined.
FEW_MODELS = 1000


def _hash(key: list[str]) -> Column:
    """The hash by which Spark deals rows: a task of a power of two of them
    has the rows of one bucket, or of buckets of its own."""
    return F.hash(*key).bitwiseAND(F.lit((1 << MAX_DEPTH) - 1))


def _tasks(rows: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(rows, 1) / TASK_ROWS)))


def buckets_of(state: dict, table: str) -> list[tuple[int, int, str]]:
    """(depth, end, path) of a table's buckets in a manifest's state."""
    return [tuple(b) for b in state.get(table, [])] or [(0, 0, "")]


def _pair(bucket: int) -> tuple[int, int]:
    """(depth, end) of a bucket's number."""
    return bucket >> MAX_DEPTH, bucket & ((1 << MAX_DEPTH) - 1)


def with_bucket(df: DataFrame, table: str, buckets: Iterable[tuple[int, int]]) -> DataFrame:
    """``df`` with the number of the bucket of each row: its hash's end is a
    bucket's at exactly one of the depths in use (few numbers)."""
    ends = {}
    for d, e in sorted(buckets):
        ends.setdefault(d, []).append(e)
    found = []
    for d, known in ends.items():
        end = _hash(TABLES[table]).bitwiseAND(F.lit((1 << d) - 1))
        number = end.cast("long") + F.lit(d << MAX_DEPTH).cast("long")
        found.append(number if len(known) == 1 << d else F.when(end.isin(known), number))
    return df.withColumn("bucket", F.coalesce(*found))


def _sizes(df: DataFrame, table: str, buckets: Iterable[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Rows in each bucket (at most as many as there are buckets)."""
    return {_pair(r.bucket): r.n for r in with_bucket(df, table, buckets).groupBy("bucket").agg(F.count("*").alias("n")).collect()}


def _split(sizes: dict[tuple[int, int], int], max_rows: int) -> list[tuple[int, int]]:
    """Buckets of more than ``max_rows`` rows go as many bits deeper as their
    rows ask for."""
    out = []
    for (d, e), n in sizes.items():
        deeper = min(d + max(0, math.ceil(math.log2(n / max_rows))), MAX_DEPTH)
        out += [(deeper, y) for y in range(e, 1 << deeper, 1 << d)]
    return out


def _read(spark: SparkSession, base: str, paths: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{base}/{p}" for p in paths]) if paths else spark.createDataFrame([], schema)


def _written(spark: SparkSession, base: str, path: str) -> list[tuple[int, int, str]]:
    """The buckets in a folder."""
    fs, p = mf._fs(spark, f"{base}/{path}")
    found = [s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("bucket=")] if fs.exists(p) else []
    return [(*_pair(int(n.removeprefix("bucket="))), f"{path}/{n}") for n in found]


def _replaced(old: list[tuple[int, int, str]], touched: set[tuple[int, int]], new: list[tuple[int, int, str]]) -> list:
    """The buckets after a batch: those not touched and the new ones; a
    touched bucket (or a part of a split one) that got no rows stays, empty."""
    out = [b for b in old if b[:2] not in touched]
    have = {(d, e) for d, e, _ in new}
    for d, e in touched:
        parts = [(x, y) for x, y in have if x >= d and y % (1 << d) == e]
        depth = max((x for x, _ in parts), default=d)
        out += [(depth, y, "") for y in range(e, 1 << depth, 1 << d) if (depth, y) not in have]
    return sorted([*out, *new])


def merge_batch(spark: SparkSession, batch: DataFrame, number: int, base: str, cohort: DataFrame, languages: DataFrame,
                max_rows: int = MAX_ROWS, n_slots: int = 1, intervals: dict | None = None, **guard) -> mf.Manifest:
    """Keep-last merge of one batch into the log, and refresh of the cube, the
    aggregate and (with ``intervals``, the options of ``metric_intervals``) the
    intervals of the models that it touches (K1, K2); one commit.

    The guard is decided as in the batch job (``operators.log``).
    """
    held = mf.current(spark, base)
    if held.state.get("batch", -1) >= number:
        return held  # a replay
    state = {"batch": number, "layout": LAYOUT}
    ours = held.state.get("layout") == LAYOUT
    schema = batch.schema
    standing = {t: buckets_of(held.state, t) if ours else [(0, 0, "")] for t in TABLES}

    def rows_of(table: str, hit: set[tuple[int, int]]) -> list[str]:
        """Where the rows of the touched buckets are; of another layout, all."""
        return [p for d, e, p in buckets_of(held.state, table) if p and (not ours or (d, e) in hit)]

    # The models and buckets that the batch touches.
    scratch = f"{base}/tables/models/s-{uuid.uuid4().hex}"
    (with_bucket(batch, "log", [b[:2] for b in standing["log"]]).groupBy("bucket", "model").agg(F.count("*").alias("n"))
     .write.parquet(f"{scratch}/seen"))
    seen = spark.read.schema("bucket long, model string, n long").parquet(f"{scratch}/seen")
    by_bucket = seen.groupBy("bucket").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    if not by_bucket:
        return mf.commit(spark, base, held, held.paths, held.state | {"batch": number})
    hit = {_pair(r.bucket) for r in by_bucket} if ours else {(0, 0)}
    sizes = {_pair(r.bucket): r.n for r in by_bucket}
    if max(r.most for r in by_bucket) > TASK_ROWS:
        # Maybe many copies of a key: combined map-side, they aren't one task's.
        keep_last(batch).select(schema.names).write.parquet(f"{scratch}/batch")
        batch = spark.read.schema(schema).parquet(f"{scratch}/batch")
        sizes = _sizes(batch, "log", hit)

    # Log and cube: the touched buckets, dealt by cell once.  A cell is whole
    # in its task, which merges its rows, counts them and writes both tables.
    rows = batch
    if old := rows_of("log", hit):
        old = _read(spark, base, old, schema)
        for r in old.groupBy("_metadata.file_path").count().collect():  # as many as files; from their footers
            pair = _pair(int(r.file_path.split("/bucket=")[1].split("/")[0])) if ours else (0, 0)
            sizes[pair] = sizes.get(pair, 0) + r["count"]
        rows = rows.unionByName(old)
    # Copies count here: a bucket may be split somewhat early.
    buckets = _split(sizes, max_rows)
    merged = keep_last(rows.repartition(_tasks(sum(sizes.values())), *CELL)).select(schema.names)
    both, path = log_and_cube(merged, n_slots=n_slots), f"tables/log/v-{uuid.uuid4().hex}"
    with_bucket(both, "log", buckets).write.partitionBy("kind", "bucket").parquet(f"{base}/{path}")
    for table in ("log", "cube"):
        state[table] = _replaced(standing[table], hit, _written(spark, base, f"{path}/kind={table}"))

    # Aggregate and intervals: the touched models, whole, from the cube.
    models = seen.select("model").distinct()
    cube = _read(spark, base, [p for _, _, p in state["cube"] if p], score_cube(merged, n_slots=n_slots).schema)
    tasks = max(_tasks(cube.count()), 1 << (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    few = [r.model for r in models.limit(FEW_MODELS + 1).collect()]
    cube = cube.where(F.col("model").isin(few)) if len(few) <= FEW_MODELS else cube.join(models, "model", "left_semi")

    def refresh(table: str, fresh: DataFrame) -> None:
        """Replace the rows of ``models`` by ``fresh`` ones, which are made once."""
        hit = set(_sizes(models, table, [b[:2] for b in standing[table]])) if ours else {(0, 0)}
        rows = fresh
        if old := rows_of(table, hit):
            old = _read(spark, base, old, fresh.schema).repartition(tasks, "model")
            rows = fresh.unionByName(old.join(models, "model", "left_anti"))
        rows = rows.persist(StorageLevel.DISK_ONLY)
        try:
            buckets, path = _split(_sizes(rows, table, hit), max_rows), f"tables/{table}/v-{uuid.uuid4().hex}"
            if buckets:
                with_bucket(rows, table, buckets).write.partitionBy("bucket").parquet(f"{base}/{path}")
            state[table] = _replaced(standing[table], hit, _written(spark, base, path))
        finally:
            rows.unpersist()

    board = guarded_cells(cells_of(cube.repartition(tasks, "model")), cohort, languages, n_slots=n_slots, by_model=True, **guard)
    refresh("results", board.where("published").select(*CELL, "score", "origin"))
    if intervals is not None:
        refresh("intervals", metric_intervals(cube, "model", **intervals).repartition(tasks, "model"))
    fs, p = mf._fs(spark, scratch)
    fs.delete(p, True)

    paths = {t: [p for _, _, p in state[t] if p] for t in TABLES if t in state}
    return mf.commit(spark, base, held, paths, state)


def start_log_merge(spark: SparkSession, incoming: str, schema: StructType, base: str, checkpoint: str, cohort: DataFrame,
                    languages: DataFrame, files_per_batch: int | None = None, **how):
    """Streaming query over ``incoming`` that merges each micro-batch (K1, K2)
    into the tables under ``base``."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(incoming)
    return (stream.writeStream
            .foreachBatch(lambda df, epoch: merge_batch(spark, df, epoch, base, cohort, languages, **how))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start())


def start_error_rate(spark: SparkSession, incoming: str, schema: StructType, out_path: str,
                     checkpoint: str):
    """Running per-model totals and error rate while results arrive (K3).

    State is one row per model.  There is no event time in the log, so no
    watermark is needed for correctness; each epoch appends the updated rows
    with its epoch number, and the latest epoch per model is the current
    value.
    """
    stream = spark.readStream.schema(schema).parquet(incoming)
    counts = stream.groupBy("model").agg(F.count(F.lit(1)).alias("rows"),
                                         F.count_if(not_ok()).alias("not_ok"))

    def sink(df, epoch):
        # One folder an epoch: a replayed epoch overwrites its own rows.
        (df.withColumn("epoch", F.lit(epoch).cast("long"))
         .withColumn("error_rate", F.col("not_ok") / F.col("rows"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("epoch").parquet(out_path))

    return (counts.writeStream.outputMode("update").foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_error_rate(spark: SparkSession, out_path: str) -> DataFrame:
    """Latest running value per model from the appended updates (K3)."""
    t = spark.read.parquet(out_path)
    latest = F.max_by(F.struct("rows", "not_ok", "error_rate"), F.col("epoch"))
    return t.groupBy("model").agg(latest.alias("_l")).select("model", "_l.*")
