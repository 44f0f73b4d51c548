"""Session construction and the shared scratch location.

Every job that has to cut lineage or persist an intermediate result writes
under the directory the cluster names in ``spark.checkpoint.dir``.  The
setting is read from the running session; a private directory is only
created when it is unset and the master is local (tests), and is removed when
the process ends.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "sieveworks",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Create (or reuse) a session tuned for the library's plans.

    On a cluster the master and most settings come from spark-submit; the
    values below are defaults for local runs only.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if master and master.startswith("local") and not os.environ.get("SPARK_DRIVER_MEMORY"):
        # local mode runs every task inside the driver JVM; on a cluster the
        # executor sizes come from spark-submit instead
        builder = builder.config("spark.driver.memory", os.environ.get("SIEVEWORKS_LOCAL_MEMORY", "12g"))
    cores = os.cpu_count() or 8
    parts = shuffle_partitions or max(8, 2 * cores)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory, creating a private one only
    when the session does not name one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="sieveworks-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str):
    """Write ``df`` once as a parquet table below the shared checkpoint
    directory and return the table.  Cuts lineage like ``checkpoint()``
    but computes the input a single time and stores it columnar."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)
