"""Counts of reader notifications over a stream: an extension, as drawings have no streams of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plotweave.functions.scalars import masked


def windowed_patterns(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Notifications by type and masked message in windows of ``width``; rows later than ``late`` are left out by the engine.

    Works on batches and streams alike; a stream keeps state only for windows that the watermark hasn't passed.
    """
    return (
        stream.withWatermark("ts", late).withColumn("pattern", masked(F.col("message")))
        .groupBy(F.window("ts", width).alias("w"), "type", "pattern").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), "type", "pattern", "n")
    )
