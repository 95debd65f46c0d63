"""Streams of revised observations: the latest revision of each date, and quarterly aggregates with late data.

The batch operators say what is right; these give the same numbers from a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quarters import quarter_index


def latest_revisions(stream: DataFrame, keys: Sequence[str], revised: str, value: str) -> DataFrame:
    """Per key the value of its newest revision, kept as a running aggregate (use output mode update or complete)."""
    return stream.groupBy(*keys).agg(F.max(F.struct(revised, value)).alias("_newest")).select(*keys, F.col(f"_newest.{revised}").alias(revised), F.col(f"_newest.{value}").alias(value))


def windowed(stream: DataFrame, at: str, width: str, late: str, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, last and count per key and tumbling window; rows later than `late` are dropped and windows closed."""
    return (
        stream.withWatermark(at, late)
        .groupBy(F.window(at, width).alias("_w"), *keys)
        .agg(F.avg(value).alias("mean"), F.max_by(value, at).alias("last"), F.count(value).alias("n"))
        .select(*keys, F.col("_w.start").alias("start"), "mean", "last", "n")
    )


def quarterly(stream: DataFrame, at: str, keys: Sequence[str], value: str) -> DataFrame:
    """Running quarterly means per key (quarters are few, so their state is kept)."""
    return stream.groupBy(*keys, quarter_index(at).alias("quarter_idx")).agg(F.avg(value).alias("value"))
