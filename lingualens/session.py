"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for every job in this library.  AQE re-plans joins
# (broadcast conversion from *measured* shuffle sizes), coalesces small
# partitions and splits skewed ones; nothing here pins a physical strategy.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    # Static planning sizes a parquet scan by its *compressed* bytes, which
    # understates a projected table several-fold, so a large fact table can
    # look broadcastable.  Keep the static bar low and let AQE convert joins
    # to broadcast from the measured size of the shuffled side.
    "spark.sql.autoBroadcastJoinThreshold": str(1 << 20),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(16 << 20),
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "lingualens", extra: dict | None = None) -> SparkSession:
    """Session for tests and the local benchmark (``local[cores]``)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("LINGUALENS_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A folder that the context already has, or that ``spark.checkpoint.dir``
    names, is used as it is.  Only a local session without either (as in
    tests) gets a private folder; on a cluster executors couldn't see one, so
    there it is an error.
    """
    sc = spark.sparkContext
    held = sc.getCheckpointDir()
    if held:
        # The context's folder is a subfolder of its own in the one that was set.
        return spark.conf.get("spark.checkpoint.dir", None) or held
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="lingualens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return configured


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint location for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
