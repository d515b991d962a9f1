"""A session with the settings the library expects: UTC, so that timestamps without zone survive casts, and adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "anemos", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
