"""Session settings the library relies on at scale."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan with real sizes: small sides are broadcast, partitions are merged.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where its join feeds a grouping on the same key.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A packet or a picture is one value of any size: what goes to Python at a time is bounded by bytes, not by rows alone.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8MB",
    # Dates are read and shown in the session zone.
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession, **changes: str) -> SparkSession:
    for name, value in {**SETTINGS, **changes}.items():
        spark.conf.set(name, value)
    return spark
