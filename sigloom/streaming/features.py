"""Window features of a stream of samples: an extension, with event time and a watermark for late samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_features(samples: DataFrame, key: str, time: str, length: str, slide: str | None = None, late: str = "10 seconds") -> DataFrame:
    """Root mean square, mean absolute value and variance of ``value`` per key and event-time window of a streaming table."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    value = F.col("value")
    found = samples.withWatermark(time, late).groupBy(window, key).agg(F.sqrt(F.avg(value * value)).alias("rms"), F.avg(F.abs(value)).alias("mav"), F.var_samp(value).alias("var"), F.count("*").alias("n"))
    return found.select(key, F.col("window.start").alias("start"), "rms", "mav", "var", "n")
