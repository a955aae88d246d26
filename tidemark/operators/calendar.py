"""Half-hour calendar of local delivery days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import timeutil as t

SLOTS = 50


def settlement_calendar(spark: SparkSession, start: str, end: str, zone: str = "Europe/London", cutoff_hour: int = 9, holidays: DataFrame | None = None) -> DataFrame:
    """One row per half-hour of each local day from start to end.

    day, period, start_utc, hour_utc, start_local, cutoff_utc, weekday, local_hour, month, day_of_year, is_holiday.
    """
    days = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}')) AS day")
    days = days.withColumns({"day_start": t.day_start_utc("day", zone), "day_end": t.day_start_utc(F.date_add("day", 1), zone), "cutoff_utc": t.cutoff_utc("day", zone, cutoff_hour)})
    rows = days.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    rows = rows.withColumn("start_utc", t.add_minutes("day_start", F.col("slot") * 30)).filter("start_utc < day_end")
    rows = rows.withColumn("start_local", t.to_local("start_utc", zone))
    out = rows.select(
        "day",
        (F.col("slot") + 1).alias("period"),
        "start_utc",
        F.date_trunc("hour", "start_utc").cast("timestamp_ntz").alias("hour_utc"),
        "start_local",
        "cutoff_utc",
        t.iso_weekday("day").alias("weekday"),
        t.fractional_hour("start_local").alias("local_hour"),
        F.month("day").alias("month"),
        F.dayofyear("day").alias("day_of_year"),
    )
    if holidays is None:
        return out.withColumn("is_holiday", F.lit(False))
    flag = holidays.select(F.col("holiday_date").alias("day"), F.lit(True).alias("_h")).distinct()
    return out.join(flag, "day", "left").withColumn("is_holiday", F.coalesce("_h", F.lit(False))).drop("_h")
