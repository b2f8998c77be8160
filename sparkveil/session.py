"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (on a cluster it is installed or shipped)."""
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parent.parent)
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
    return spark
