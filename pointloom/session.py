"""A session with the settings this library expects; on a cluster only what the cluster leaves open is set."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "pointloom", **conf: str) -> SparkSession:
    """Adaptive execution on, UTC, Arrow transfer; further settings as keywords with `_` for `.`."""
    builder = SparkSession.builder.appName(app)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (base | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
