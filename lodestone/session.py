"""Session settings shared by tests, the bench and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(cpus: int | None = None, app: str = "lodestone") -> SparkSession:
    """A local session; on a cluster, pass your own session to every operator instead."""
    n = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
