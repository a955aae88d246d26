"""Read models (M1 to M7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.metrics import pooled
from tidemark.operators.series import rolling_mean, running


def preferred(live: DataFrame, backtest: DataFrame, keys: list[str]) -> DataFrame:
    """M1, M5: live rows, and backtest rows for keys that have none."""
    return live.withColumn("origin", F.lit("live")).unionByName(backtest.join(live.select(*keys).distinct(), keys, "left_anti").withColumn("origin", F.lit("backtest")))


def latest_day(df: DataFrame, day: str) -> DataFrame:
    """F7."""
    return df.join(F.broadcast(df.agg(F.max(day).alias(day))), day, "left_semi")


def between_days(df: DataFrame, day: str, start: str, end: str, most: int = 31, model: str | None = None) -> DataFrame:
    """M2: at most `most` days."""
    import datetime as dt

    if (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days + 1 > most:
        raise ValueError(f"more than {most} days")
    out = df.filter(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return out.filter(F.col("model") == model) if model else out


def coverage_over_time(daily: DataFrame, window: int, day: str = "day") -> DataFrame:
    """M3."""
    return rolling_mean(daily, "coverage", ["model"], [day], window)


def cumulative_pnl(daily: DataFrame, day: str = "day") -> DataFrame:
    """M4."""
    return running(daily, "net", ["strategy"], [day])


def totals(daily: DataFrame) -> DataFrame:
    """M6: record so far, days weighted by their priced periods."""
    days = daily.groupBy("model").agg(F.countDistinct("day").alias("days"))
    return pooled(daily, ["pinball", "coverage"], "n", ["model"]).join(days, "model")


def health(outputs: dict[str, DataFrame], day: str, version: str | None = None, tie: list[str] | None = None) -> DataFrame:
    """M7: per output whether it has rows, its latest day, and the version (of a model, say) that made the row of that day."""
    made = F.max_by(version, F.struct(day, *(tie or []))).cast("string") if version else F.lit(None).cast("string")
    parts = [df.agg(F.lit(name).alias("output"), (F.count("*") > 0).alias("present"), F.max(day).cast("string").alias("latest"), made.alias("version")) for name, df in outputs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def most_volatile_week(df: DataFrame, ts: str, value: str, least: int) -> DataFrame:
    """week with enough rows and the highest deviation."""
    w = df.groupBy(F.date_trunc("week", ts).cast("date").alias("week")).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd")).filter(F.col("n") >= least)
    return w.orderBy(F.desc("sd"), "week").limit(1)


def top_by(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """first k rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
