"""Streams of observations: means by interval, and pairing with a static forecast axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import to_seconds


def observation_means(stream: DataFrame, time: str, keys: list[str], value: str | Column, every: str = "6h", late: str = "1 hour") -> DataFrame:
    """Mean of ``value`` for each key and interval, with ``valid_time`` its start; later records are dropped.

    Works on static frames too, where the watermark has no effect.
    """
    column = F.col(value) if isinstance(value, str) else value
    window = F.window(F.col(time), f"{to_seconds(every)} seconds")
    out = stream.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(F.avg(column).alias("value"), F.count(column).alias("n"))
    return out.select(F.col("w.start").alias("valid_time"), *keys, "value", "n")


def pair_stream(observations: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    """Each observation with every run and lead of a static forecast that is valid then."""
    return observations.join(forecast, ["valid_time", *keys], "inner")
