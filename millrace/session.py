"""Session settings of the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with adaptive execution and UTC; ANSI stays on, lenient results are asked for expression by expression."""
    builder = SparkSession.builder.appName("millrace").config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()
