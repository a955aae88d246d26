"""Trailing statistics from panes (C6 to C8, D1, I8): a series is summed once per pane of time, and each cutoff adds up its panes.

A row is in one pane, so work grows with the rows and with cutoffs times panes
in a band, not with rows times bands that they are in.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Panes of a band, at most; a cutoff gathers these in one row.
MOST_PANES = 4096


def _seconds(c: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))


def pane_width(days: DataFrame, cutoff: str, widths: list[int]) -> int:
    """Seconds of the widest pane whose edges all bands (of the given widths in seconds) of all cutoffs begin and end at.

    Cutoffs of a day at the same clock time have one or two remainders; with
    many it is the second that divides all, or an error where bands would have over MOST_PANES panes.
    """
    day = F.pmod(_seconds(cutoff), F.lit(86_400_000_000)).alias("r")
    width = gcd(*widths, 86_400) * 1_000_000
    for r in days.select(day).filter("r is not null").distinct().limit(1000).collect():
        width = gcd(width, r.r)
    if width % 1_000_000 or max(widths) * 1_000_000 // width > MOST_PANES:
        raise ValueError(f"cutoffs need panes of {width} microseconds")
    return width // 1_000_000


def panes(series: DataFrame, available: str, width: int, values: dict[str, Column], by: list[str] | None = None, last: dict[str, tuple[Column, list[str]]] | None = None) -> DataFrame:
    """One row per pane (by, _pane): for each of `values` a struct of n, total, mean, m2, low, high; for each of `last` the last known value with its time.

    A pane is open on the left and closed on the right, like the bands. m2 is
    the sum of squared deviations from the pane's own mean. last maps a name to
    (value, columns that break ties).
    """
    number = F.floor((_seconds(available) - 1) / F.lit(width * 1_000_000)).cast("long").alias("_pane")
    out = []
    for name, c in values.items():
        n = F.count(c)
        out.append(F.struct(n.alias("n"), F.sum(c).alias("total"), F.avg(c).alias("mean"), (F.var_pop(c) * n).alias("m2"), F.min(c).alias("low"), F.max(c).alias("high"), F.max(F.when(c.isNotNull(), F.col(available))).alias("at")).alias(name))
    for name, (c, tie) in (last or {}).items():
        place = F.struct(F.col(available).alias("at"), *[F.col(x) for x in tie])
        out.append(F.max(F.when(c.isNotNull(), F.struct(place.alias("place"), c.alias("value")))).alias(name))
    return series.filter(F.col(available).isNotNull()).groupBy(*(by or []), number).agg(*out, F.max(available).alias("_newest"))


def _added(name: str) -> list[Column]:
    """n, total, mean, sd, low and high of the panes gathered in a column; deviations of pane means from the mean of all are added to those inside."""
    at = lambda field: F.transform(name, lambda p: p[field])
    plus = lambda c: F.aggregate(F.filter(c, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x)
    n = F.aggregate(at("n"), F.lit(0).cast("long"), lambda s, x: s + x)
    total = F.when(n > 0, plus(at("total")))
    mean = total / F.nullif(n, F.lit(0).cast("long"))
    m2 = plus(F.transform(name, lambda p: p["m2"] + p["n"] * (p["mean"] - F.col(f"_{name}_mean")) * (p["mean"] - F.col(f"_{name}_mean"))))
    sd = F.when(n > 1, F.sqrt(m2 / (n - 1)))
    return [n.alias(f"{name}_n"), total.alias(f"{name}_total"), mean.alias(f"{name}_mean"), sd.alias(f"{name}_sd"), F.array_min(at("low")).alias(f"{name}_low"), F.array_max(at("high")).alias(f"{name}_high"), F.array_max(at("at")).alias(f"{name}_at")]


def combined(days: DataFrame, paned: DataFrame, cutoff: str, seconds: int, width: int, values: list[str], by: list[str] | None = None, last: list[str] | None = None) -> DataFrame:
    """days with <name>_n, _total, _mean, _sd, _low, _high and _at (time of the newest) of each value over (cutoff - seconds, cutoff], <name>_last and _last_at, and newest, the time of the last row of all.

    width is that of the panes; see pane_width. Empty bands have nulls, and
    n of 0. `days` should hold one row per cutoff (and by), not per half-hour.
    """
    keys = [*(by or []), cutoff]
    top = F.floor(_seconds(cutoff) / F.lit(width * 1_000_000)).cast("long") - 1
    wanted = days.select(*keys).filter(F.col(cutoff).isNotNull()).distinct().withColumn("_pane", F.explode(F.sequence(top - (seconds // width - 1), top)))
    met = wanted.join(paned, [*(by or []), "_pane"])
    gathered = met.groupBy(*keys).agg(*[F.collect_list(v).alias(v) for v in values], *[F.max(v).alias(v) for v in last or []], F.max("_newest").alias("newest"))
    for v in values:
        sums = F.aggregate(v, F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct((a["s"] + F.coalesce(p["total"], F.lit(0.0))).alias("s"), (a["n"] + p["n"]).alias("n")))
        gathered = gathered.withColumn(f"_{v}_sums", sums).withColumn(f"_{v}_mean", F.col(f"_{v}_sums.s") / F.nullif(F.col(f"_{v}_sums.n"), F.lit(0).cast("long")))
    found = gathered.select(*keys, *[c for v in values for c in _added(v)], *[c for v in last or [] for c in (F.col(f"{v}.value").alias(f"{v}_last"), F.col(f"{v}.place.at").alias(f"{v}_last_at"))], "newest")
    return days.join(found, keys, "left").na.fill(0, [f"{v}_n" for v in values])
