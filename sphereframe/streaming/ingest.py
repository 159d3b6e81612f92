"""Streaming ingest of points into cells: an extension on Structured Streaming, beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphereframe.functions import cells as C


def windowed_rollup(stream: DataFrame, level: int, window: str = "1 day", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """stream: ts, ord, k, value.  Count and sum for each time window and ancestor; events later than the watermark are dropped by it."""
    keyed = stream.withColumn("parent", C.parent("k", "ord", F.lit(level)))
    return keyed.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "parent").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "parent", "n", "total")
