"""Spark session settings and the shared work folder.

Cluster runs bring their own session; the settings below are what the
library expects from it (UTC, AQE) and what tests use locally.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings every job relies on: event time is read as UTC, AQE may re-plan
# joins (broadcast when a side is small at run time, split skewed partitions)
# and coalesce small shuffle partitions.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when the join's partitioning feeds a later
    # grouping on the same key (one user may hold a third of all rows).
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Let AQE size the partitions of persisted tables too (the training
    # split is persisted and iterated over by the tree learners).
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = 8,
                  app_name: str = "txsentry") -> SparkSession:
    """Session for tests, the bench and the command line (UI off, UTC, AQE on).
    What a submitted job was given with ``--conf`` is kept."""
    builder = SparkSession.builder.appName(app_name)
    settings = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | SESSION_DEFAULTS
    if master:
        builder = builder.master(master)
        settings["spark.driver.memory"] = "16g"
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    given = SparkConf()
    for k, v in settings.items():
        if not given.contains(k):
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_session_defaults(spark)
    return spark


def ensure_session_defaults(spark: SparkSession) -> None:
    """Runtime settings the operators rely on: UTC session time (feature
    hours are UTC) and AQE skew handling."""
    for k, v in SESSION_DEFAULTS.items():
        if k.startswith("spark.sql.") and k != "spark.sql.execution.arrow.pyspark.enabled":
            spark.conf.set(k, v)


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables and checkpoints.

    Taken from ``spark.checkpoint.dir`` (the cluster's shared folder).  Only
    when the session has none — local tests — a fresh folder under the
    system temp dir is created and registered as the checkpoint dir.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = spark.sparkContext.getCheckpointDir()
    if not conf_dir:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="txsentry-ckpt-")
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path inside the shared work folder."""
    return os.path.join(work_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
