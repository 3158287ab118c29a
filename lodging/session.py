"""Session settings the jobs rely on, and where shared scratch output goes.

Cluster-provided settings always win: ``configure`` only fills a setting the
session does not already carry.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the queries assume.  AQE re-plans joins and coalesces or splits
# shuffle partitions from runtime sizes; UTC pins date/time conversion.
# HotSpot does not JIT-compile methods over 8000 bytecodes.  A wide fused
# stage (the test-data derivation fused with the 41-column enrichment was
# one) generates such a method and then runs interpreted, about 2.5x slower.
# Clusters should pass the same flag through spark.executor.extraJavaOptions;
# here it goes to the local driver JVM.
JIT_OPTIONS = "-XX:-DontCompileHugeMethods"

REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the required SQL settings that the session leaves unset."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None, app: str = "lodging") -> SparkSession:
    """A local session for tests and the benchmark (never used on a cluster)."""
    parts = str(shuffle_partitions or (os.cpu_count() if cores == "*" else cores))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.extraJavaOptions", JIT_OPTIONS)
        .config("spark.executor.extraJavaOptions", JIT_OPTIONS)
    )
    for key, value in REQUIRED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for job output under the cluster's shared checkpoint dir.

    Reads ``spark.checkpoint.dir`` from the session.  Where it is unset, a
    one-machine session (``local[...]``: tests, the benchmark) gets a folder
    of its own; on a cluster every executor would write to its own disk, so
    that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lodging-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}"
