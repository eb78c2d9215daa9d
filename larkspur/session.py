"""Session settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "larkspur", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI errors and adaptive execution."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
