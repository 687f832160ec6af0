"""The aggregate builders over streams, an extension: watermarked windows, sessions and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, time: str, size: str, aggs: dict[str, Column], by: list[str] | None = None, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregates by time window; ``late`` is how long a stream waits for late rows. Works on tables and streams."""
    source = df.withWatermark(time, late) if late else df
    return source.groupBy(F.window(time, size, slide), *(by or [])).agg(*[c.alias(n) for n, c in aggs.items()]).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(by or []), *aggs)


def sessions(df: DataFrame, time: str, gap: str, aggs: dict[str, Column], by: list[str], late: str | None = None) -> DataFrame:
    source = df.withWatermark(time, late) if late else df
    return source.groupBy(F.session_window(time, gap).alias("s"), *by).agg(*[c.alias(n) for n, c in aggs.items()]).select(*by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), *aggs)


def distinct_within(df: DataFrame, columns: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key, remembered for ``late`` on a stream."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(columns) if df.isStreaming else df.dropDuplicates(columns)
