"""Data contracts: each returns the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, column: str) -> DataFrame:
    """K1."""
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys (without nulls) found more than once, and how often."""
    return unique_combination(df.dropna(subset=columns), columns)


def unique_combination(df: DataFrame, columns: list[str]) -> DataFrame:
    """K3: keys found more than once, those with nulls among them."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """K4: nulls pass."""
    return df.filter(~F.col(column).isin(values))


def accepted_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """K5: nulls pass; either bound may be missing."""
    bad = [F.col(column) < low] if low is not None else []
    bad += [F.col(column) > high] if high is not None else []
    return df.filter(reduce(Column.__or__, bad, F.lit(False)))


def relationships(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Non-null child keys without a parent."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")


def point_in_time(df: DataFrame, groups: dict[str, list[str]], cutoff: str = "cutoff_utc") -> DataFrame:
    """K7: rows where an availability is after the cutoff, or a feature is there without one.

    groups maps each availability column to the features that it vouches for.
    """
    bad = F.lit(False)
    for available, features in groups.items():
        a = F.col(available)
        bad = bad | F.coalesce(a > F.col(cutoff), F.lit(False))
        for f in features:
            bad = bad | (F.col(f).isNotNull() & a.isNull())
    return df.filter(bad)


def clock_changes(calendar: DataFrame, zone: str) -> DataFrame:
    """Days whose half-hours are not 1 to n with n as the zone's clock has it."""
    from tidemark.functions.timeutil import periods_in_day

    per = calendar.groupBy("day").agg(F.count("*").alias("n"), F.min("period").alias("lo"), F.max("period").alias("hi"))
    return per.withColumn("expected", periods_in_day("day", zone)).filter("n <> expected or lo <> 1 or hi <> expected")


def guard_exercised(spine: DataFrame, vintages: DataFrame, on: list[str], issued: str, cutoff: str = "cutoff_utc") -> DataFrame:
    """One row, the number of pairs of a spine row and a vintage that came after its cutoff and so could have leaked."""
    from tidemark.operators.asof import known_counts

    per = known_counts(spine, vintages, on, issued, cutoff)
    return per.agg(F.coalesce(F.sum(F.col("n_vintages") - F.col("n_known")), F.lit(0)).alias("n_after_cutoff"))


def summary(checks: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Contract, severity, violations and whether it fails (errors only)."""
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("contract"), F.lit(severity).alias("severity"), "violations") for name, (df, severity) in checks.items()]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("failed", (F.col("severity") == "error") & (F.col("violations") > 0))


def freshness(df: DataFrame, loaded: str, now: str, warn_hours: float, error_hours: float, by: list[str] | None = None) -> DataFrame:
    """Age of the newest row against two limits; now is a naive UTC timestamp."""
    latest = df.groupBy(*(by or [])).agg(F.max(loaded).alias("latest"))
    age = F.timestamp_diff("SECOND", F.col("latest"), F.lit(now).cast("timestamp_ntz")) / 3600.0
    state = F.when(age.isNull() | (age > error_hours), "error").when(age > warn_hours, "warn").otherwise("pass")
    return latest.withColumns({"age_hours": age, "state": state})


def infeasible(schedule: DataFrame, power: float, energy: float, efficiency: float, step_hours: float, keys: list[str], order: str, start: float = 0.0, eps: float = 1e-6, discharge_efficiency: float = 1.0, low: float = 0.0) -> DataFrame:
    """Periods of a schedule (charge_mw, discharge_mw, soc_mwh) that no battery could run.

    The level starts and ends at `start`, stays within low and energy, and falls
    by what is discharged over the discharge efficiency.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    before = F.coalesce(F.lag("soc_mwh").over(w), F.lit(start))
    moved = before + step_hours * (F.col("charge_mw") * efficiency - F.col("discharge_mw") / discharge_efficiency)
    out = schedule.withColumns({"_gap": F.abs(F.col("soc_mwh") - moved), "_last": F.lead(order).over(w).isNull()})
    bad = (F.col("charge_mw") < -eps) | (F.col("discharge_mw") < -eps) | (F.greatest("charge_mw", "discharge_mw") > power + eps)
    bad = bad | (F.least("charge_mw", "discharge_mw") > eps) | (F.col("soc_mwh") < low - eps) | (F.col("soc_mwh") > energy + eps)
    bad = bad | (F.col("_gap") > eps) | (F.col("_last") & (F.abs(F.col("soc_mwh") - start) > eps))
    return out.filter(bad).drop("_gap", "_last")


def not_dominated(results: DataFrame, bound: str, keys: list[str], value: str, strategy: str = "strategy", eps: float = 1e-6) -> DataFrame:
    """Results above those of the bound with the same keys."""
    best = results.filter(F.col(strategy) == bound).select(*keys, F.col(value).alias("_bound"))
    return results.filter(F.col(strategy) != bound).join(best, keys).filter(F.col(value) > F.col("_bound") + eps)
