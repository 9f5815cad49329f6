"""A session with the settings the library is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tonegraph", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI, adaptive execution with skew-join splitting; conf: further settings, dots as double underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
