"""The five-sum estimator in event-time windows; the same plan runs on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.estimators import five_sums, mean_and_deviation


def windowed(samples: DataFrame, time: str, length: str, by: list[str], r: Column, e: Column, late: str | None = None) -> DataFrame:
    """(window, by..., expect, dev); on a stream `late` sets the watermark that lets windows close."""
    rows = samples.withWatermark(time, late) if late else samples
    return rows.groupBy(F.window(time, length), *by).agg(*five_sums(r, e)).select("window", *by, *mean_and_deviation())
