"""Schedules and their settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import interpolated


def prepared_days(df: DataFrame, day: str, period: str, price: str, lengths=(46, 48, 50), share: float = 0.9) -> DataFrame:
    """L1: days of an accepted length and priced well enough, gaps interpolated (`<price>_filled`)."""
    ok = df.groupBy(day).agg(F.count("*").alias("_n"), F.avg(F.col(price).isNotNull().cast("double")).alias("_s")).filter(F.col("_n").isin(*lengths) & (F.col("_s") >= share)).select(day)
    return interpolated(df.join(ok, day, "left_semi"), price, [day], period)


def fixed_rule(df: DataFrame, by: list[str], order: str, charge: Column, discharge: Column, power: float, energy: float, efficiency: float, step_hours: float) -> DataFrame:
    """Charges in one window until full, discharges in another until empty, blind to prices.

    A group's rows (a day's) are folded in order by a higher-order function; a
    schedule that doesn't end empty is undone.
    """
    row = F.struct(F.col(order), charge.alias("_c"), discharge.alias("_d"))
    folded = df.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    zero = F.struct(F.lit(0.0).alias("soc"), F.array().cast("array<struct<at:string,charge_mw:double,discharge_mw:double,soc_mwh:double>>").alias("out"))

    def step(state, r):
        c = F.when(r["_c"], F.least(F.lit(power), (F.lit(energy) - state["soc"]) / (efficiency * step_hours))).otherwise(0.0)
        d = F.when(r["_d"] & ~r["_c"], F.least(F.lit(power), state["soc"] / step_hours)).otherwise(0.0)
        soc = state["soc"] + step_hours * (c * efficiency - d)
        made = F.struct(r[order].cast("string").alias("at"), c.alias("charge_mw"), d.alias("discharge_mw"), soc.alias("soc_mwh"))
        return F.struct(soc.alias("soc"), F.concat(state["out"], F.array(made)).alias("out"))

    done = folded.withColumn("s", F.aggregate("rows", zero, step)).withColumn("ok", F.abs("s.soc") < 1e-9)
    out = done.select(*by, "ok", F.inline("s.out"))
    keep = lambda c: F.when(F.col("ok"), F.col(c)).otherwise(0.0).alias(c)
    return out.select(*by, F.col("at").alias(order), keep("charge_mw"), keep("discharge_mw"), keep("soc_mwh"))


def settle(schedule: DataFrame, by: list[str], price: str, energy: float, step_hours: float, wear_per_mwh: float, discharge_efficiency: float = 1.0) -> DataFrame:
    """L3: revenue, degradation, net, MWh discharged and cycles (of energy taken from the store) per group, at actual prices."""
    moved = F.sum("discharge_mw") * step_hours
    revenue = F.sum(F.col(price) * (F.col("discharge_mw") - F.col("charge_mw"))) * step_hours
    out = schedule.groupBy(*by).agg(revenue.alias("revenue"), (moved * wear_per_mwh).alias("degradation"), moved.alias("mwh"))
    return out.withColumns({"net": F.col("revenue") - F.col("degradation"), "cycles": F.col("mwh") / discharge_efficiency / energy})


def filled_decisions(df: DataFrame, by: list[str], period: str, columns: list[str], actual: str) -> DataFrame:
    """L1: decision columns interpolated within a group; one that has no value there takes the group's mean of `actual`."""
    for c in columns:
        df = interpolated(df, c, by, period)
    mean = F.avg(actual).over(Window.partitionBy(*by))
    return df.withColumns({c: F.coalesce(f"{c}_filled", mean) for c in columns}).drop(*[f"{c}_filled" for c in columns])


def strategies_with_bound(daily: DataFrame, bound: DataFrame, name: str) -> DataFrame:
    """Daily results of all strategies with those of the bound added under its name, and each one's shortfall from it."""
    rows = daily.unionByName(bound.withColumn("strategy", F.lit(name)).select(*daily.columns))
    best = F.max(F.when(F.col("strategy") == name, F.col("net"))).over(Window.partitionBy("day"))
    return rows.withColumn("shortfall", best - F.col("net"))


def decision_prices(df: DataFrame, routes: dict[str, str]) -> DataFrame:
    """L4: one row per strategy with the column it decides by."""
    pairs = F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(c).cast("double").alias("decision_price")) for s, c in routes.items()])
    return df.withColumn("_p", F.explode(pairs)).select(*df.columns, "_p.*")


def best_block(df: DataFrame, by: list[str], order: str, price: str, k: int, efficiency: float = 1.0) -> DataFrame:
    """Highest spread of a k-period sale over an earlier k-period purchase in each group, 0 at least."""
    w = Window.partitionBy(*by).orderBy(order)
    block = F.sum(price).over(w.rowsBetween(0, k - 1))
    rows = df.withColumns({"_sum": block, "_full": F.count(price).over(w.rowsBetween(0, k - 1)) == k}).withColumn("_cost", F.when(F.col("_full"), F.col("_sum")))
    cheapest = F.min("_cost").over(w.rowsBetween(Window.unboundedPreceding, -k))
    rows = rows.withColumn("_spread", F.when(F.col("_full"), F.col("_sum") * efficiency - cheapest))
    return rows.groupBy(*by).agg(F.greatest(F.coalesce(F.max("_spread"), F.lit(0.0)), F.lit(0.0)).alias("best_spread"))
