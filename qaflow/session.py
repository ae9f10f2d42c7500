"""SparkSession factory with the settings the queries assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "qaflow", master: str | None = None, settings: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; ``settings`` add to these or override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    common = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=common | (settings or {})).getOrCreate()
