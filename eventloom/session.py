"""Spark session with the settings the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "eventloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution, skew handling and partition coalescing; ``conf`` overrides."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for k, v in {**settings, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
