"""Streaming forms of the time-ordered inputs: windows with watermarks over records as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(records: DataFrame, time: str, value: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Count and sum per key and window; works on batches and streams (late: how long a stream waits)."""
    timed = records.withWatermark(time, late) if records.isStreaming else records
    out = timed.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(records: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    timed = records.withWatermark(time, late) if records.isStreaming else records
    out = timed.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n")
