"""Event tables in text files: ``session condition onset [duration [amplitude]]``, any usual delimiter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_paradigm(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """(session, condition, onset, duration, amplitude). Missing durations are 0, missing amplitudes 1.

    Without a delimiter, commas, semicolons and blanks separate fields. Lines that hold no event are left out.
    """
    separator = r"\s*[,;\s]\s*" if delimiter is None else rf"\s*\Q{delimiter}\E\s*"
    field = F.split(F.trim(F.regexp_replace("value", '"', "")), separator)
    part = lambda i, kind: F.try_element_at(field, F.lit(i + 1)).try_cast(kind)
    out = spark.read.text(path).select(
        part(0, "double").cast("int").alias("session"), part(1, "string").alias("condition"), part(2, "double").alias("onset"), F.coalesce(part(3, "double"), F.lit(0.0)).alias("duration"), F.coalesce(part(4, "double"), F.lit(1.0)).alias("amplitude")
    )
    return out.filter("session IS NOT NULL AND onset IS NOT NULL")


def write_paradigm(events: DataFrame, path: str) -> None:
    """Blank-separated lines with quoted names."""
    line = F.concat_ws(" ", F.col("session").cast("string"), F.concat(F.lit('"'), F.col("condition"), F.lit('"')), F.col("onset").cast("string"), F.col("duration").cast("string"), F.lit("1."))
    events.select(line.alias("value")).write.mode("overwrite").text(path)
