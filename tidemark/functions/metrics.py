"""Forecast metrics as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeutil import quantile_name
from tidemark.sources.staging import staged


def pinball(y: str, q: str, alpha: float) -> Column:
    """Loss of one row."""
    d = F.col(y) - F.col(q)
    return F.greatest(alpha * d, (alpha - 1) * d)


def mean_pinball(y: str, quantiles: list[float]) -> Column:
    """A row's loss averaged over quantiles."""
    parts = [pinball(y, quantile_name(q), q) for q in quantiles]
    return sum(parts[1:], parts[0]) / len(parts)


def interval(y: str, low: str, high: str) -> Column:
    """Inclusive at both ends; null without y."""
    return F.col(y).between(F.col(low), F.col(high)).cast("double")


def metric_columns(y: str = "y", quantiles: list[float] = (0.1, 0.5, 0.9)) -> list[Column]:
    """D8 to D11 over rows whose y is known."""
    qs = list(quantiles)
    mid, low, high = (quantile_name(q) for q in (0.5, min(qs), max(qs)))
    known = F.col(y).isNotNull()
    err = F.when(known, F.col(mid) - F.col(y))
    out = [F.count_if(known).alias("n"), F.avg(mean_pinball(y, qs)).alias("pinball")]
    out += [F.avg(pinball(y, quantile_name(q), q)).alias(f"pinball_{quantile_name(q)}") for q in qs]
    out += [F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(err).alias("bias")]
    out += [F.avg(interval(y, low, high)).alias("coverage"), F.avg(F.when(known, F.col(high) - F.col(low))).alias("width")]
    out += [F.avg((F.col(y) <= F.col(quantile_name(q))).cast("double")).alias(f"share_below_{quantile_name(q)}") for q in qs]
    return out


def scope_summary(df: DataFrame, scope: Column, baseline: str, y: str = "y", quantiles=(0.1, 0.5, 0.9), model: str = "model") -> DataFrame:
    """Metrics per model for all rows and per scope, in one aggregation, with skill against a baseline model."""
    both = df.withColumn("scope", F.explode(F.array(F.lit("all"), scope)))
    out = both.groupBy("scope", model).agg(*metric_columns(y, quantiles))
    base = F.max(F.when(F.col(model) == baseline, F.col("pinball"))).over(Window.partitionBy("scope"))
    return out.withColumn("skill", 1 - F.col("pinball") / F.nullif(base, F.lit(0.0)))


def pooled(df: DataFrame, metrics: list[str], weight: str, by: list[str]) -> DataFrame:
    """Means of daily metrics weighted by their rows."""
    return df.groupBy(*by).agg(F.sum(weight).alias(weight), *[(F.sum(F.col(m) * F.col(weight)) / F.sum(F.when(F.col(m).isNotNull(), F.col(weight)))).alias(m) for m in metrics])


def paired_gain(df: DataFrame, base: str, other: str, day: str, fold: str) -> DataFrame:
    """One row: mean daily gain of `other` over `base`, relative gain, folds won of how many."""
    daily = df.groupBy(fold, day).agg(F.avg(F.col(base) - F.col(other)).alias("gain"), F.avg(base).alias("base"))
    folds = daily.groupBy(fold).agg(F.avg("gain").alias("fold_gain"), F.sum("gain").alias("s"), F.sum("base").alias("b"), F.count("*").alias("d"))
    return folds.agg((F.sum("s") / F.sum("d")).alias("mean_gain"), (F.sum("s") / F.nullif(F.sum("b"), F.lit(0.0))).alias("relative_gain"), F.count_if(F.col("fold_gain") > 0).alias("folds_won"), F.count("*").alias("folds"))


def drawn(seed: int, repeat: Column, place: Column, most: Column) -> Column:
    """A number from 0 to most - 1 that depends on seed, repeat and place only, by md5, so that any engine can draw it."""
    text = F.concat_ws("-", F.lit(str(seed)), repeat.cast("string"), place.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), most.cast("long"))


def block_bootstrap(daily: DataFrame, value: str, day: str, block: int = 7, repeats: int = 2000, seed: int = 0) -> DataFrame:
    """Low and high, the 2.5 and 97.5 % limits of the mean over resampled blocks of consecutive days.

    Values are summed up from the first day on, so the sum of a block is one
    difference, and a repeat costs its blocks and not its days. Days without a
    value are left out before. What is ordered in one task is a row per day.
    """
    spark = daily.sparkSession
    known = daily.filter(F.col(value).isNotNull())
    so_far = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    sums = known.select(F.row_number().over(so_far).cast("long").alias("i"), F.sum(F.col(value).cast("double")).over(so_far).alias("s"))
    sums = staged(sums.unionByName(spark.range(1).select(F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("s"))), "sums")
    n = F.broadcast(sums.agg(F.max("i").alias("n")).filter("n > 0"))
    draws = spark.range(repeats).withColumnRenamed("id", "repeat").crossJoin(n)
    draws = draws.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1)))
    draws = draws.withColumn("start", drawn(seed, F.col("repeat"), F.col("k"), F.greatest(F.col("n") - block + 1, F.lit(1))))
    draws = draws.withColumn("stop", F.col("start") + F.least(F.lit(block), F.col("n") - F.col("k") * block))
    draws = draws.join(sums.toDF("start", "_a"), "start").join(sums.toDF("stop", "_b"), "stop")
    means = draws.groupBy("repeat").agg((F.sum(F.col("_b") - F.col("_a")) / F.max("n")).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def strategy_totals(daily: DataFrame, bound: str, naive: str, days_per_year: float = 365.25) -> DataFrame:
    """Per strategy revenue, net, per-year value, cycles a day, share of the bound and of the gap to it."""
    out = daily.groupBy("strategy").agg(F.sum("revenue").alias("revenue"), F.sum("net").alias("net"), F.avg("cycles").alias("cycles_a_day"), F.countDistinct("day").alias("days"))
    every = Window.partitionBy()
    top, low = (F.max(F.when(F.col("strategy") == s, F.col("net"))).over(every) for s in (bound, naive))
    return out.withColumns(
        {
            "net_a_year": F.col("net") / F.col("days") * days_per_year,
            "capture": F.when(top > 0, F.col("net") / top),
            "gap_closed": F.when(top > low, (F.col("net") - low) / (top - low)),
        }
    )
