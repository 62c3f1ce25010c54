"""Session settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def builder(app: str = "meridion") -> SparkSession.Builder:
    """Adaptive execution on, exchange-local dates read as UTC, NaN kept out at the scan (see sources)."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
