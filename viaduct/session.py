"""Session factory: adaptive execution on, UTC, Arrow on, one OpenMP thread per task."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "viaduct", cores: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session; on a cluster, spark-submit's settings win over these defaults."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
