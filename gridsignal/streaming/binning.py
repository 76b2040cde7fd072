"""Event streams on the same grid as event tables (an extension: batches and streams share the raster)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned(events: DataFrame, time: str, by: list[str], width: str, lateness: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts (and sums of ``value``) of events in windows of ``width``; events later than ``lateness`` are dropped.

    Works on a stream, where the watermark bounds the state, and on a table.
    """
    out = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return events.withWatermark(time, lateness).groupBy(F.window(time, width), *by).agg(*out).select(F.col("window.start").alias("start"), *by, *["n", "total"][: len(out)])
