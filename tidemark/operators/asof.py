"""As-of joins of vintages against a cutoff."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Per key the first row in `order`; make the order total for a fixed result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


#: Width of the buckets of time in which a key's history is ordered, unless the caller says otherwise: one task holds one
#: bucket of one key at most, and one more the buckets of a key. HOUR suits keys with millions of vintages a day.
BUCKET = "DAY"


def _timeline(spine: DataFrame, vintages: DataFrame, on: list[str], issued: str, bound: Column, payload: list[str], tie: list[str], bucket: str) -> DataFrame:
    """Spine rows and vintages in one table by key and time: _t, _spine (null for a vintage), _v (null for a spine row), _tie."""
    keys = [F.col(k).alias(f"_k{n}") for n, k in enumerate(on)]
    a = spine.select(*keys, bound.alias("_t"), F.struct(*[F.col(f"`{c}`") for c in spine.columns]).alias("_spine"))
    v = vintages.filter(F.col(issued).isNotNull()).dropna(subset=on)
    v = v.select(*keys, F.col(issued).alias("_t"), F.struct(*payload, issued).alias("_v"), F.struct(F.lit(0), *tie).alias("_tie"))
    return a.unionByName(v, allowMissingColumns=True).withColumn("_b", F.date_trunc(bucket, "_t"))


def _with_carry(rows: DataFrame, keys: list[str], inside: dict[str, Column], per_bucket: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """rows with columns of a window inside each bucket, and what all earlier buckets of the key hand on (one row per bucket)."""
    order = Window.partitionBy(*keys, "_b").orderBy("_t", F.col("_spine").isNotNull(), "_tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: c.over(order) for n, c in inside.items()})
    buckets = rows.groupBy(*keys, "_b").agg(*[c.alias(n) for n, c in per_bucket.items()])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(*[F.col(k).alias(f"c{k}") for k in (*keys, "_b")], *[c.over(before).alias(n) for n, c in carried.items()])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"c{k}")) for k in (*keys, "_b")])
    return rows.filter(F.col("_spine").isNotNull()).join(buckets, same, "left")


def asof_join(
    spine: DataFrame,
    vintages: DataFrame,
    on: list[str],
    payload: list[str],
    issued: str,
    cutoff: str = "cutoff_utc",
    tie: list[str] | None = None,
    how: str = "left",
    shift_minutes: int = 0,
    bucket: str = BUCKET,
) -> DataFrame:
    """Each spine row with the payload of its newest vintage issued at or before the cutoff.

    Spine and vintages are put into one timeline per key, cut into buckets of
    time. Inside a bucket a window finds the last vintage so far; a second one
    over one row per bucket hands the last vintage of earlier buckets on. So the
    work grows with the rows of both sides and not with cutoffs times history,
    and a key with a long history is many tasks.

    Vintages without issue time or key never match. Rows without a vintage have
    nulls (how="left") or are dropped (how="inner", C4). Of vintages issued at
    the same time the last by `tie` wins. shift_minutes moves the cutoff, for a
    leaky control (C17).
    """
    bound = F.col(cutoff) + F.expr(f"INTERVAL {shift_minutes} MINUTE") if shift_minutes else F.col(cutoff)
    keys = [f"_k{n}" for n in range(len(on))]
    rows = _timeline(spine, vintages, on, issued, bound, payload, tie or [], bucket)
    last = F.last("_v", ignorenulls=True)
    best = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct("_t", "_tie")))
    out = _with_carry(rows, keys, {"_here": last}, {"_best": best}, {"_before": F.last("_best", ignorenulls=True)})
    found = F.when(F.col("_t").isNotNull(), F.coalesce("_here", "_before"))
    out = out.withColumn("_found", found).select("_spine.*", *[F.col(f"_found.{c}").alias(c) for c in (*payload, issued)])
    return out.filter(F.col(issued).isNotNull()) if how == "inner" else out


def known_counts(spine: DataFrame, vintages: DataFrame, on: list[str], issued: str, cutoff: str = "cutoff_utc", of_all: bool = True, bucket: str = BUCKET) -> DataFrame:
    """Spine rows with n_known, the vintages of their key issued by the cutoff, and (of_all) n_vintages, all of them; same plan as asof_join."""
    keys = [f"_k{n}" for n in range(len(on))]
    rows = _timeline(spine, vintages, on, issued, F.col(cutoff), [], [], bucket)
    seen, here = F.count("_v"), F.count("_v")
    out = _with_carry(rows, keys, {"_here": seen}, {"_n": here}, {"_before": F.sum("_n")})
    known = F.when(F.col("_t").isNotNull(), F.col("_here") + F.coalesce("_before", F.lit(0))).otherwise(F.lit(0))
    if not of_all:
        return out.select("_spine.*", known.alias("n_known"))
    all_ = rows.groupBy(*keys).agg(F.count("_v").alias("n_vintages")).select(*[F.col(k).alias(f"t{k}") for k in keys], "n_vintages")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"t{k}")) for k in keys])
    return out.join(all_, same).select("_spine.*", known.alias("n_known"), "n_vintages")


def local_lag_join(spine: DataFrame, series: DataFrame, value: str, available: str, days: int, local: str = "start_local", start: str = "start_utc", cutoff: str = "cutoff_utc") -> DataFrame:
    """Value at the same wall clock `days` days earlier if available by the cutoff; of a repeated hour the later."""
    past = series.select((F.col(local) + F.expr(f"INTERVAL {days} DAY")).alias(local), F.col(value).alias("_v"), F.col(available).alias("_a"), F.col(start).alias("_s"))
    hit = spine.select(local, cutoff, start).join(past, local).filter(F.col("_a") <= F.col(cutoff))
    best = hit.groupBy(start).agg(F.max_by(F.struct("_v", "_a"), "_s").alias("_b"))
    return spine.join(best, start, "left").withColumns({f"{value}_lag_{days}d": F.col("_b._v"), f"{value}_lag_{days}d_available_at": F.col("_b._a")}).drop("_b")


def newer_vintage_existed(picked: DataFrame, vintages: DataFrame, on: list[str], issued: str, cutoff: str = "cutoff_utc") -> DataFrame:
    """Picks for which a newer vintage was there by the cutoff; empty when the join is right.

    Each pick stands in one timeline twice, at its cutoff and at its own issue
    time; the vintages counted up to the first less those up to the second are
    the newer ones. No pair is listed. A pick without a vintage has none up to
    its issue time.
    """
    marks = F.array(F.struct(F.col(cutoff).alias("_mark"), F.lit(1).alias("_sign")), F.struct(F.col(issued).alias("_mark"), F.lit(-1).alias("_sign")))
    twice = picked.select(*on, cutoff, issued, F.inline(marks))
    counted = known_counts(twice, vintages, on, issued, "_mark", of_all=False)
    # equal picks are one group, and each of them is returned
    equal = F.count_if(F.col("_sign") > 0)
    per = counted.groupBy(*on, cutoff, issued).agg(equal.alias("_equal"), F.sum(F.col("_sign") * F.col("n_known")).alias("_sum")).filter("_sum > 0")
    return per.select(*on, cutoff, issued, (F.col("_sum") / F.col("_equal")).cast("long").alias("n_newer"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_equal"))).alias("_")).drop("_")


def fixed_lead_join(spine: DataFrame, vintages: DataFrame, on: list[str], payload: list[str], lead: int, issued: str, cutoff: str = "cutoff_utc", lead_col: str = "lead_days") -> DataFrame:
    """Vintage of one lead whatever the cutoff, with `issued_late` telling whether it came after it."""
    v = vintages.filter(F.col(lead_col) == lead).select(*on, *payload, issued)
    return spine.join(v, on, "left").withColumn("issued_late", (F.col(issued) > F.col(cutoff)).cast("int"))


def late_share(joined: DataFrame) -> DataFrame:
    """One row: how many rows have a vintage, and which share of these was issued late."""
    return joined.agg(F.count("issued_late").alias("n"), F.avg("issued_late").alias("share_late"))
