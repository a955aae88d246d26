"""Trailing-band joins without a nested loop, for what panes can't add up (C6, D1); see operators.panes for counts, sums, means, deviations, extremes and last values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(days: DataFrame, series: DataFrame, cutoff: str, available: str, seconds: int, by: list[str] | None = None) -> DataFrame:
    """Rows of series with available in (cutoff - seconds, cutoff], for each row of days.

    Time is cut into buckets as wide as the band, so every match lies in the
    cutoff's bucket or the one before: days are doubled, series rows are not,
    and the join is an equi-join on bucket (and `by`) with the band as residual.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    bucket = lambda c: F.floor(F.timestamp_diff("MICROSECOND", epoch, F.col(c)) / F.lit(seconds * 1_000_000)).cast("long")
    left = days.withColumn("_b", F.explode(F.array(bucket(cutoff), bucket(cutoff) - 1)))
    right = series.withColumn("_b", bucket(available))
    width = F.expr(f"INTERVAL {seconds} SECOND")
    inside = (F.col(available) <= F.col(cutoff)) & (F.col(available) > F.col(cutoff) - width)
    return left.join(right, [*(by or []), "_b"]).filter(inside).drop("_b")


def trailing(days: DataFrame, series: DataFrame, cutoff: str, available: str, seconds: int, aggregates: list[Column], by: list[str] | None = None) -> DataFrame:
    """Aggregates of the band for every row of days, nulls where it is empty.

    `days` should hold one row per cutoff, not per half-hour.
    """
    keys = [*(by or []), cutoff]
    keyed = days.select(*keys).distinct()
    found = band_join(keyed, series, cutoff, available, seconds, by).groupBy(*keys).agg(*aggregates)
    return days.join(found, keys, "left")
