"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",  # buckets are aligned to the epoch
    "spark.sql.variant.allowDuplicateKeys": "true",  # JSON with a repeated key still parses
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session; returns it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
