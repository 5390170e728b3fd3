"""Session defaults shared by tests, benches and applications."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(cpus: int | None = None, app: str = "tessella", **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes: UTC, ANSI, AQE."""
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TESSELLA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
