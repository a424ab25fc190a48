"""Session with the settings that the engine's plans expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI semantics and adaptive execution; conf overrides (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.aggregatePushdown": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
