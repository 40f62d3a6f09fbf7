"""A session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "scholia", **settings: str) -> SparkSession:
    """UTC, adaptive execution with skewed joins split, Arrow for pandas edges. On a cluster, submit with its own master."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=conf | settings).getOrCreate()
