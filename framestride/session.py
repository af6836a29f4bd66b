"""A local session with the settings the operators expect."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def reachable(spark: SparkSession) -> SparkSession:
    """Let the session's Python workers import this package from where it lies, whatever their working folder.

    For folders that all machines see; otherwise ship the package with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """UTC, adaptive execution, as many shuffle partitions as cores. On a cluster, use its own session."""
    return reachable(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("framestride")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
