"""A contraction is linear in each operand: entries that arrive add their products to what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contract_stream(deltas: DataFrame, other: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """Running sums by `keep` of a stream of entries (..., v) joined with a static tensor (..., w); output mode update or complete."""
    return deltas.join(other, on).groupBy(*keep).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def windowed(deltas: DataFrame, time: str, width: str, late: str, keep: list[str]) -> DataFrame:
    """Sums of entries by time window and axes; entries later than `late` behind the watermark are dropped."""
    return deltas.withWatermark(time, late).groupBy(F.window(time, width), *keep).agg(F.sum("v").alias("v"))
