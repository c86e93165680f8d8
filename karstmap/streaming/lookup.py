"""Streams against an index, and windowed value histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstmap.functions.hashing import as_text


def stream_lookup(stream: DataFrame, table: DataFrame, key: str, value: str = "value", out: str = "value") -> DataFrame:
    """A stream with the value of each row's key, by a stream-static join with a relational index's table."""
    own = table.select(as_text("key").alias("__key"), F.col(value).alias(out))
    return stream.join(own, as_text(stream[key]) == own["__key"], "left").drop("__key")


def windowed_histogram(stream: DataFrame, time: str, value: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window_start, symbol and freq of each tumbling window; rows later than late are dropped."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, window), F.col(value).alias("symbol")).agg(F.count("*").alias("freq"))
    return counts.select(F.col("window.start").alias("window_start"), "symbol", "freq")
