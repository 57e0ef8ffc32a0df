"""The session's settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "loomwork", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans with skewed joins split; partition sizes are left to the cluster."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
