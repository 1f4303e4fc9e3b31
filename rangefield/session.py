"""Spark session with the settings that the library is tested under."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build(app: str = "rangefield", master: str | None = None, **conf: str) -> SparkSession:
    """A session; `master` defaults to BENCH_CPUS local threads and is left alone under spark-submit."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app).config(map=settings)
    if master or "SPARK_MASTER" not in os.environ:
        cores = os.environ.get("BENCH_CPUS", "8")
        builder = builder.master(master or f"local[{cores}]").config("spark.sql.shuffle.partitions", cores)
    return builder.getOrCreate()
