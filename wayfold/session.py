"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "wayfold", zone: str = "UTC", **conf: str) -> SparkSession:
    """A session with a fixed time zone and adaptive execution; other settings come from the cluster."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", zone).config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
