"""Counts of tumbling windows over a stream, with late events up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(stream: DataFrame, time: str, key: str, size: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, n, value_sum) per closed window in append mode; state is dropped once the watermark passes."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counted = rows.groupBy(F.window(time, size), key).agg(F.count("*").alias("n"), F.sum("value").alias("value_sum"))
    return counted.select(key, F.col("window.start").alias("start"), "n", "value_sum")
